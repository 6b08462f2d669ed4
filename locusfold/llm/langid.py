"""Language identification by string kernels.

The kernel of two texts counts the character n-grams (n = 1 to 3) that both contain, over the
square root of their own counts. Nyström landmarks turn it into finite features: a batch's kernel
to the landmarks is one matrix product, and one-versus-rest kernel ridge regression gives the
scores by another. Prediction is a map over whole texts without any shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, small_batches

#: Letters with a code of their own, by frequency in the sample; 0 is no letter, 63 any other letter.
ALPHABET = 62
_SIZES = (0, 64, 64 + 4096, 64 + 4096 + 262144)


@lru_cache(4)
def _letter_codes(letters: str) -> np.ndarray:
    codes = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if chr(i).isalpha():
            codes[i] = 63
    for k, c in enumerate(letters):
        for x in {c, c.upper()}:
            if len(x) == 1:
                codes[ord(x)] = k + 1
    return codes


def presence(text: str, letters: str, flags: np.ndarray) -> bool:
    """Mark in `flags` the n-grams that the whole text contains; whether it has a letter."""
    flags[:] = 0
    if not text:
        return False
    c = _letter_codes(letters)[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int32)
    if not c.any():
        return False
    two = c[:-1] * 64 + c[1:]
    flags[c] = 1
    flags[_SIZES[1] + two] = 1
    flags[_SIZES[2] + two[:-1] * 64 + c[2:]] = 1
    return True


def _packed(flags: np.ndarray) -> bytes:
    """The marked n-grams as numbers, or as a bitmap where that is shorter: at most _SIZES[-1] / 8 bytes and one."""
    grams = np.flatnonzero(flags).astype("<i4")
    return b"n" + grams.tobytes() if 32 * len(grams) < len(flags) else b"b" + np.packbits(flags).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    """The n-grams of `_packed` in ascending order."""
    if packed[:1] == b"n":
        return np.frombuffer(packed, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1))).astype("<i4")


def fit(docs: DataFrame, *, per_language: int = 400, landmarks: int = 40, ridge: float = 1e-2, seed: int = 7) -> dict | None:
    """Model from the rows whose crc32(id) mod 3 is not 1 and whose lang is not null; None if there are none.

    About `per_language` rows of each language are used, chosen by a hash of the id; `landmarks` of
    them per language are landmarks. Both bound what reaches the driver: n-gram sets of at most 33 kB
    each (see `_packed`), so 13 MB a language, and no texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) != 1)
    )
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    dice = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = train.filter(dice < F.element_at(share, F.col("lang")))
    letters = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", "")), "")))
    common = sample.select(letters.alias("c")).filter("length(c) = 1").groupBy("c").count().orderBy(F.desc("count"), "c").limit(ALPHABET)
    alphabet = "".join(r[0] for r in common.collect())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(_SIZES[-1], np.uint8)
        for b in batches:
            rows = [(i, lang, _packed(flags)) for i, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) if presence(t, alphabet, flags)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["id", "lang", "grams"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(sets, "id long, lang string, grams binary").collect()
    got = sorted(((r[1], r[0], bytes(r[2])) for r in got), key=lambda r: (r[0], r[1], len(r[2])))
    languages = sorted({r[0] for r in got})
    if not languages:
        return None
    marks = []
    for lang in languages:
        own = [r[2] for r in got if r[0] == lang]
        marks += [_unpacked(own[i]) for i in np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int)]
    vocab = np.unique(np.concatenate(marks))
    table = np.zeros((len(vocab), len(marks)), np.float32)
    for k, g in enumerate(marks):
        table[np.searchsorted(vocab, g), k] = 1
    sizes = np.array([len(g) for g in marks], np.float32)
    table /= np.sqrt(sizes)
    kernel = table.T.astype(np.float64) @ table
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    rows = np.zeros((len(got), len(marks)))
    for k, g in enumerate(_unpacked(r[2]) for r in got):
        at = np.minimum(np.searchsorted(vocab, g), len(vocab) - 1)
        rows[k] = table[at[vocab[at] == g]].sum(0) / np.sqrt(len(g))
    x = np.c_[rows @ whiten, np.ones(len(rows))]
    y = np.array([[1.0 if r[0] == lang else -1.0 for lang in languages] for r in got])
    w = np.array([1.0 / max(1, sum(r[0] == g[0] for r in got)) for g in got])
    w *= len(got) / w.sum()
    solved = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y * w[:, None]))
    return {"letters": alphabet, "vocab": vocab, "table": table, "project": whiten @ solved[:-1], "bias": solved[-1], "languages": languages}


def _scorer(model: dict):
    """Function of a list of texts: (predicted languages, scores)."""
    flags = np.zeros(_SIZES[-1], np.uint8)

    def score(texts: list) -> tuple[list[str], np.ndarray]:
        if not model:
            return ["und"] * len(texts), np.zeros(len(texts))
        grams = np.zeros((len(texts), len(model["vocab"])), np.float32)
        size, has = np.ones(len(texts), np.float32), np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            if presence(t, model["letters"], flags):
                has[k], size[k] = True, np.count_nonzero(flags)
                grams[k] = flags[model["vocab"]]
        out = (grams @ model["table"] / np.sqrt(size)[:, None]) @ model["project"] + model["bias"]
        soft = np.exp(3 * (out - out.max(1, keepdims=True)))
        soft /= soft.sum(1, keepdims=True)
        best = soft.argmax(1)
        names = [model["languages"][i] if h else "und" for i, h in zip(best, has, strict=True)]
        return names, np.where(has, soft[np.arange(len(texts)), best], 0.0)

    return score


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A text that is null or has no letter is `und` with score 0, and so is everything without a
    model. Null and repeated ids are kept (a null id is not held out); only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # landmarks and their n-grams: bounded by the parameters of `fit`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for b in batches:
            names, likely = score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(likely, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """`predict` for all of `docs` (doc_id, text, lang) by the model that `fit` learns from them.

    Null ids, texts and languages, repeated rows and other columns are as stated there; without labelled
    rows every text is `und`, and an empty table gives an empty result. Runs the jobs of `fit`.
    """
    return predict(docs, fit(docs))


def keep_known(docs: DataFrame, languages: Collection[str] | None = None, min_score: float = 0.4) -> DataFrame:
    """The rows of `docs` whose predicted language is one of `languages` (all learnt ones by default) with a score of
    `min_score` or more; they stay as they are.

    Null texts and texts without letters go. Repeated rows, null ids and other columns are kept. Without
    labelled rows nothing is learnt, and all rows with a letter stay. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def known(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = _scorer(shared.value)
        for text in frames:
            names, likely = score(text.tolist())
            yield pd.Series([n != "und" and (languages is None or n in languages) and s >= min_score for n, s in zip(names, likely, strict=True)], dtype=bool)

    return docs.filter(known("text")) if shared.value else docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
