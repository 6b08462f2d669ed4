"""Canonical exact fingerprints.

A text is canonicalised (NFKC, case folding, NFKC again, white space runs to one space) and
hashed by 128-bit xxhash. Equal hashes form a bucket; the bytes inside every bucket of two or
more are compared, and if two different texts ever share one, all are hashed again with the next
seed. So equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, map_rows, slot_bitmap, small_batches

def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str, seed: int = 0) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode(), seed)


def likeness(a: str, b: str) -> float:
    """Of two exact fingerprints: 1 if equal, else 0."""
    return float(a == b)


def shared_slots(docs: DataFrame, text_col: str, seed: int) -> np.ndarray:
    """Bitmap of the hash slots that two or more rows fall in."""
    slots = map_rows(
        docs.select(F.col(text_col).alias("text")), "slot int",
        lambda c: {"slot": [int(digest(canonical(t or ""), seed)[:6], 16) % SLOTS for t in c["text"]]},
    )
    return slot_bitmap(slots.groupBy("slot").count().filter("count > 1").select("slot"))


def collisions(docs: DataFrame, text_col: str, seed: int) -> bool:
    """Whether two different canonical texts have one digest.

    Copies are combined before the shuffle, so a text that many rows share is sent once per task.
    """
    small_batches(docs.sparkSession)
    bitmap = shared_slots(docs, text_col, seed)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                canon = canonical(t or "")
                d = digest(canon, seed)
                slot = int(d[:6], 16) % SLOTS
                if bitmap[slot >> 3] >> (7 - (slot & 7)) & 1:
                    rows.append((d, canon))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["digest", "canon"])

    texts = docs.select(text_col).mapInArrow(suspects, "digest string, canon string")
    return not texts.distinct().groupBy("digest").count().filter("count > 1").isEmpty()


def safe_seed(docs: DataFrame, text_col: str = "text") -> int:
    """The first seed under which equal digests mean equal canonical bytes."""
    seed = 0
    while collisions(docs, text_col, seed):
        seed += 1
    return seed


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a column fingerprint. A null text counts as empty."""
    seed = safe_seed(docs, text_col)

    @F.pandas_udf("string")
    def mark(text: pd.Series) -> pd.Series:
        return text.map(lambda t: digest(canonical(t or ""), seed))

    return docs.withColumn("fingerprint", mark(text_col))


def next_in_order(docs: DataFrame, id_col: str, text_col: str, fn, schema: str) -> DataFrame:
    """`fn(id, text, next text)` for every row, where next goes by descending id and wraps around.

    One exchange by ranges of (id, hash of the text). Each range also gets the topmost row of the range
    below it (the lowest range: of the highest), so no window spans the table; an id with the rows of
    several ranges, and the null id, are divided by the hash. Rows of equal id are ordered by that
    hash, so equal rows stay together; null ids are the lowest; a null text counts as empty. A single
    row is its own next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n, n_null = ids.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    null_ranges = parts * n_null // n if n else 0
    quantiles = ids.filter("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts, ranges = np.unique(np.array(quantiles, dtype=np.int64), return_counts=True)
    passed = null_ranges + np.append(0, np.cumsum(ranges))  # ranges below each cut

    @F.pandas_udf("int")
    def part(i: pd.Series, known: pd.Series, h: pd.Series) -> pd.Series:
        known, value = known.to_numpy(bool), i.to_numpy(np.int64)
        high = (h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        below = np.searchsorted(cuts, value, "left")
        at_cut = np.searchsorted(cuts, value, "right") > below
        pieces = np.where(at_cut, np.append(ranges, 1)[below], 1)
        divided = (high * np.where(known, pieces, null_ranges + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return pd.Series(np.where(known, passed[below] + at_cut * (1 + divided), divided).astype("int32"))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("part", part(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), "hash"))
    tops = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max(F.struct("id", "hash"))).collect()}  # a row per range
    order = sorted(tops)
    after = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    known = F.create_map(*[F.lit(x) for p in order for x in (p, after[p])]) if order else F.create_map(F.lit(0), F.lit(0))

    def top(field: str) -> Column:
        pairs = [x for p in order for x in (F.lit(p), F.lit(tops[p][field]).cast("long"))] or [F.lit(0), F.lit(0).cast("long")]
        return F.element_at(F.create_map(*pairs), F.col("part"))

    is_top = F.col("id").eqNullSafe(top("id")) & (F.col("hash") == top("hash"))
    own = F.struct("part", F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(known, F.col("part")).alias("part"), F.lit(True).alias("guest"))
    dealt = rows.withColumn(
        "to", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own)))
    ).select("to.part", "to.guest", "id", "text", "hash")
    # the exchange keeps the rows of a range together, in order; a range's guests come first
    dealt = dealt.repartition(parts // 2, "part").sortWithinPartitions(
        "part", F.col("guest").desc(), F.col("id").asc_nulls_first(), "hash"
    ).drop("hash")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the text below, and the range it is for
        for batch in batches:
            out = []
            for p, is_guest, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_guest:
                    out.append(fn(i, text, before))
                before = text
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(walk, schema)


def edit_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last third comes from the next document.

    A row for each row of `docs`; other columns are ignored. A null text counts as empty. Null ids are the lowest;
    rows of one id follow each other by the hash of their text. A single row is its own next; an empty table gives
    an empty result.
    """
    seed = safe_seed(docs, text_col)

    def report(i, text: str, follower: str) -> tuple:
        n = len(text)
        k = n // 3
        edited = text[:n - k] + follower[:k]
        own, other, beside = canonical(text), canonical(edited), canonical(follower)
        return (
            i, n, hashlib.sha256(edited.encode()).hexdigest(), digest(own, seed), digest(other, seed),
            likeness(own, other), likeness(own, beside),
        )

    return next_in_order(
        docs, id_col, text_col, report,
        f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
