"""Ranks and exact quantiles by counts of distinct values in value ranges, so that no task sorts a whole group.

A missing value is null or NaN; it has no rank and takes no part in a statistic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(*cols: str | Column) -> Column:
    """Whether all of these are neither null nor NaN."""
    out = F.lit(True)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out = out & c.isNotNull() & ~F.isnan(c.cast("double"))
    return out


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """`left` with the other columns of `right`; null keys meet null keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # without keys `right` has one row
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how).drop(*[f"_right_{k}" for k in keys])


def cuts_of(df: DataFrame, values: Sequence[str]) -> list[list[float]]:
    """Ends of value ranges of several columns, one range for each shuffle partition: one job reads `df` once for all of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(1, parts)]
    if not probs:
        return [[] for _ in values]
    found = df.select(*[F.col(v).cast("double").alias(f"_{i}") for i, v in enumerate(values)]).approxQuantile([f"_{i}" for i in range(len(values))], probs, 0.25 / parts)
    return [sorted({c for c in cuts if float("-inf") < c < float("inf")}) for cuts in found]


def in_ranges(df: DataFrame, value: str, out: str = "_range", cuts: Sequence[float] | None = None) -> DataFrame:
    """`df` with the number of the value range that a row lies in. Without `cuts`, a job finds them while the plan is built."""
    from pyspark.ml.feature import Bucketizer

    cuts = cuts_of(df, [value])[0] if cuts is None else cuts
    rows = df.withColumn("_range_of", F.col(value).cast("double"))
    if not cuts:
        return rows.withColumn(out, F.lit(0.0)).drop("_range_of")
    return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_range_of", outputCol=out, handleInvalid="keep").transform(rows).drop("_range_of")


def ranked_values(df: DataFrame, value: str, per: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """(per, value, _n, _upto, _total): every distinct value, its rows, the rows up to it and all rows of its group.

    Ties are one row each. Counts are added up within value ranges and shifted by those of the ranges below.
    """
    counts = in_ranges(df.filter(present(value)), value, cuts=cuts).groupBy(*per, "_range", value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*per)
    sums = counts.groupBy(*per, "_range").agg(F.sum("_n").alias("_s"))  # a row per group and range
    sums = sums.select(*per, "_range", (F.sum("_s").over(group.orderBy("_range")) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*per, "_range").orderBy(value))
    return join_same(counts.withColumn("_upto", upto), sums, [*per, "_range"], "inner").select(*per, value, "_n", (F.col("_upto") + F.col("_before")).alias("_upto"), "_total")


def avg_rank(df: DataFrame, value: str, partition: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """`df` with midranks of a value, ties averaged, within `partition`; a missing value has none."""
    ranks = ranked_values(df, value, partition).select(*partition, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return join_same(df, ranks, [*partition, value])


def avg_ranks(df: DataFrame, values: Mapping[str, str], partition: Sequence[str] = ()) -> DataFrame:
    """`df` with midranks of several values (column -> name): `df` is read once for the ends of all ranges, then once for each value and once for the result."""
    out = df
    for (value, name), cuts in zip(values.items(), cuts_of(df, list(values)), strict=True):
        ranks = ranked_values(df, value, partition, cuts).select(*partition, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
        out = join_same(out, ranks, [*partition, value])
    return out


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], per: Sequence[str] = ()) -> DataFrame:
    """(per, a column per name): exact quantiles with linear interpolation; groups without values are absent."""
    rows = ranked_values(df, value, per)
    aggs = []
    for name, p in probs.items():
        at = p * (F.col("_total") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{end}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    got = rows.groupBy(*per).agg(*aggs)
    part = lambda n: F.col(f"_{n}_lo") + F.when(F.col(f"_{n}_part") == 0, 0.0).otherwise(F.col(f"_{n}_part") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")))
    return got.select(*per, *[part(n).alias(n) for n in probs])
