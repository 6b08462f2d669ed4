import random

import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "straße", "été", "zeta", "eta", "theta", "iota"]
    prose = " ".join(rng.choice(words) for _ in range(400))
    rows = [
        (1, prose, "en"), (2, prose, "en"), (2, prose, "en"), (3, None, None), (4, "", "en"), (5, "   \n", None), (6, "one two", "de"), (7, "one two", "de"),
        (8, prose + " " + prose[:900], "fr"), (9, "a" * 20000, "en"), (10, "12 34 !?", "en"), (None, prose, "en"), (11, prose[:700] + " other tail here", None),
        (12, "😀 naïve \x1c\x85 text", "fr"), (13, prose.upper(), "de"),
    ]
    return spark.createDataFrame(
        [(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, hash string"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
