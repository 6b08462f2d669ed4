"""Fill-in-the-middle: texts cut at two unit borders and put together again in another order.

One match of (unit)* keeps every repetition of its group, so the ends of the units, their number and both cuts come
from one call. Only three numbers a text return from Python; the texts themselves stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Layout:
    """Markers, the pattern of a unit, and how many of a hundred texts are cut and lead with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[A-Za-z]++|[^A-Za-z]"
    cut_percent: int = 90
    suffix_first_percent: int = 20
    seed: str = "1"


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of an id, from a hash; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cutter(layout: Layout):
    """Column function (text, draw, draw) -> struct<n, a, b>: units, and code points before the first and second cut."""
    pattern = f"({layout.unit})*+"

    @F.pandas_udf("struct<n: long, a: long, b: long>")
    def cut(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        whole = regex.compile(pattern)
        rows = []
        for t, x, y in zip(texts, first, second, strict=True):
            ends = whole.fullmatch(t).ends(1)
            n = len(ends)
            i, j = sorted((x % (n + 1), y % (n + 1)))
            rows.append((n, ends[i - 1] if i else 0, ends[j - 1] if j else 0))
        return pd.DataFrame(rows, columns=["n", "a", "b"])

    return cut


def fill_in_middle(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of each text.

    A null text counts as empty; empty texts and texts that hold a marker stay plain, with null lengths. Ids may be null
    or repeat (equal ids cut alike); other columns are ignored.
    """
    small_batches(docs.sparkSession)
    h1, h2, h3, h4 = draws(F.col("doc_id"), layout.seed)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), h3.alias("h3"), h4.alias("h4"), cutter(layout)(text, h1, h2).alias("cut"))
    marked = F.lit(False)
    for m in (layout.prefix, layout.suffix, layout.middle):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= layout.cut_percent), "plain").when(F.col("h4") % 100 < layout.suffix_first_percent, "spm").otherwise("psm")
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    p, s, m = F.lit(layout.prefix), F.lit(layout.suffix), F.lit(layout.middle)
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.a")).alias("prefix_chars"), F.when(cut, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column, layout: Layout = Layout()) -> Column:
    """The text of an output: each marker is the first of its kind, since texts that hold one stay plain."""

    def after(s: Column, mark: str) -> Column:
        return F.substring(s, F.instr(s, F.lit(mark)) + len(mark), F.length(s))

    def before(s: Column, mark: str) -> Column:
        return F.substring(s, F.lit(1), F.instr(s, F.lit(mark)) - 1)

    middle = after(output, layout.middle)
    psm = F.concat(before(after(output, layout.prefix), layout.suffix), middle, before(after(output, layout.suffix), layout.middle))
    spm = F.concat(before(after(output, layout.prefix), layout.middle), middle, before(after(output, layout.suffix), layout.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """`fill_in_middle` with digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs, layout).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"), layout)).alias("restored_sha256"),
    )
