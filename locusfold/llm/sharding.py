"""Byte-balanced shards by histogram sort.

Rows are ordered by (xxhash64 of the text, row number), so equal texts lie next to each other. A
group of equal texts is one key and stays whole, unless it is larger than the tolerance: then each of
its rows is a key of its own, as the law allows no other way. Each round counts the exact bytes below a set of candidate boundaries in every partition and
narrows the interval around each wanted splitter, until the bytes below it meet the tolerance.
The rows are exchanged once, by the final splitters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

_LOW, _TOP = 0, 1 << 128


def _pack(key: int) -> bytes:
    return key.to_bytes(16, "big")


def _keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Fixed-width keys whose byte order is the order of (hi as unsigned, lo)."""
    raw = np.empty((len(hi), 2), ">u8")
    raw[:, 0] = hi.astype(np.uint64) ^ np.uint64(1 << 63)  # signed order made unsigned
    raw[:, 1] = lo.astype(np.uint64)
    return np.frombuffer(raw.tobytes(), "S16")


def below(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) with a key below each probe: partial sums per partition, then one small sum."""
    table = np.array([_pack(p) for p in probes], "S16")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, n = np.zeros(len(table) + 1, np.int64), np.zeros(len(table) + 1, np.int64)
        for f in frames:
            at = np.searchsorted(table, _keys(f["hi"].to_numpy(np.int64), f["lo"].to_numpy(np.int64)), "right")
            np.add.at(sizes, at, f["size"].to_numpy(np.int64))
            n += np.bincount(at, minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"at": at, "bytes": sizes[at], "n": n[at]})

    got = rows.select("hi", "lo", "size").mapInPandas(count, "at long, bytes long, n long")
    sums = np.zeros((len(table) + 1, 2), np.int64)
    for r in got.groupBy("at").agg(F.sum("bytes"), F.sum("n")).collect():  # a row per probe at most
        sums[r[0]] = r[1], r[2]
    total = np.cumsum(sums, axis=0)
    return {p: (int(total[i, 0]), int(total[i, 1])) for i, p in enumerate(probes)}


def splitters(rows: DataFrame, parts: int, tolerance: int, probes: int = 32) -> list[tuple[int, int, int]]:
    """Keys that cut `rows` into `parts` runs of near equal bytes: (key, bytes below, rows below) each.

    A splitter ends within `tolerance` bytes of its place, or at the nearest key where a single
    row is larger than that.
    """
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = int(total or 0)
    goals = [total * i // parts for i in range(1, parts)]
    low = {g: (_LOW, 0, 0) for g in goals}
    top = {g: (_TOP, total, n) for g in goals}
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(set(goals)):
        asked = {}
        for g in set(goals) - done.keys():
            a, b = low[g][0], top[g][0]
            asked[g] = sorted({a + (b - a) * i // (probes + 1) for i in range(1, probes + 1)} - {a, b})
        found = below(rows, sorted({p for ps in asked.values() for p in ps}))
        for g, ps in asked.items():
            for p in ps:
                if found[p][0] <= g:
                    low[g] = max(low[g], (p, *found[p]))
                else:
                    top[g] = min(top[g], (p, *found[p]))
            best = min(low[g], top[g], key=lambda x: abs(x[1] - g))
            if abs(best[1] - g) <= tolerance or top[g][2] - low[g][2] <= 1 or top[g][0] - low[g][0] <= 1:  # one row, or one key, lies between
                done[g] = best
    return sorted(done[g] for g in goals)


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.0005) -> DataFrame:
    """Every row with its shard and its place there, by the law `bytes`.

    Size is the text's UTF-8 bytes plus 1 (a null text has none and counts 1). `tolerance` is the
    part of a shard that a splitter may be off. A group of equal texts of no more bytes than that lies
    in one shard; a larger one may be cut between rows. Rows with null or repeated ids are rows like
    any other. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hi"),
            F.monotonically_increasing_id().alias("lo"),
        )
    )
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    allowed = int(total / shards * tolerance)
    # rows of a small group get one key; the large groups are at most one for each `allowed` bytes: shards / tolerance rows
    groups = rows.groupBy("hi").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = materialize(groups.filter((F.col("n") > 1) & (F.col("bytes") > allowed)).select("hi", F.lit(True).alias("cut")))
    rows = rows.join(F.broadcast(large), "hi", "left").withColumn("place", F.col("lo")).withColumn("lo", F.when(F.col("cut"), F.col("lo")).otherwise(0)).drop("cut")
    fine = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    cuts = splitters(rows, shards * fine, allowed)
    table = np.array([_pack(min(k, _TOP - 1)) for k, _, _ in cuts], "S16")

    @F.pandas_udf("int")
    def part(hi: pd.Series, lo: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, _keys(hi.to_numpy(np.int64), lo.to_numpy(np.int64)), "right").astype("int32"))

    starts = np.array([0, *(n for _, _, n in cuts)], dtype=np.int64)
    shift = (starts - starts[np.arange(len(starts)) // fine * fine]).tolist()
    within = F.row_number().over(Window.partitionBy("part").orderBy("hi", "place")) - 1
    return rows.withColumn("part", part("hi", "lo")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("part") / fine).cast("int").alias("shard"),
        (within + F.element_at(F.array(*map(F.lit, shift)), F.col("part") + 1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
