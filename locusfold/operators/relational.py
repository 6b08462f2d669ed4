"""Filters, joins, set operations and orderings of locus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_quantiles, join_same, present

AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """`df`, or an error that names the columns it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def filter_loci(df: DataFrame, motif_len: int | None = None, min_called: int = 2000, split: str | None = None,
                drop_rc: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with the counts before and after)."""
    keep = F.col("numcalled") >= min_called
    if motif_len is not None:
        keep &= F.col("motif_len") == motif_len
    if split is not None:
        keep &= F.col("split") == split
    if drop_rc:
        keep &= ~F.col("rev_comp")
    keep = F.coalesce(keep, F.lit(False))
    counters = df.agg(F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"))
    return df.filter(keep), counters


def filter_autosomes(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.filter(F.col(chrom).isin(AUTOSOMES))


def rename_carry_labels(df: DataFrame, renames: dict[str, str], strip_suffix: str = "-1", order: Sequence[str] | None = None) -> DataFrame:
    """Columns renamed where present, a suffix stripped from the others, `order` first."""
    names = {c: renames.get(c, c.removesuffix(strip_suffix) if strip_suffix else c) for c in df.columns}
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    first = [c for c in order or () if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def one_to_one_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(joined, duplicate keys of either side, unmatched left rows, counters).

    Keys that a side repeats are reported as duplicates and take no part in the join.
    """
    key = list(key)

    def repeated(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*key).count().filter("count > 1").withColumn("side", F.lit(side))

    duplicates = repeated(left, "left").unionByName(repeated(right, "right"))
    bad = duplicates.select(*key).distinct()
    left_ok, right_ok = left.join(bad, key, "left_anti"), right.join(bad, key, "left_anti")
    unmatched = left_ok.join(right_ok.select(*key), key, "left_anti")
    joined = left_ok.join(right_ok, key, how)
    counters = (
        left_ok.select(*key, F.lit(1).alias("l")).join(right_ok.select(*key, F.lit(1).alias("r")), key, "full")
        .agg(
            F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_joined"),
            F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"),
        )
    )
    return joined, duplicates, unmatched, counters


def keep_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def missing_members(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(df.select(key), key, "left_anti").orderBy(key)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def attach_metadata(df: DataFrame, meta: DataFrame, key: str = "id", cols: Sequence[str] = ()) -> DataFrame:
    """Left join of one metadata row per key: the first by the values of `cols`."""
    one = first_per_key(meta.select(key, *cols), [key], list(cols))
    return df.join(one, key, "left")


def map_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str, limit: int = 100_000) -> DataFrame:
    """`value` from a dictionary table, null when absent; the table is broadcast only if it has at most `limit` rows."""
    small = lookup.select(key, value)
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, key, "left")


def concat_results(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sample_sets(samples: DataFrame, unit: str = "chrom", sample: str = "sample") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(union, intersection, samples per unit). The number of units is counted in the same plan."""
    distinct = samples.select(unit, sample).distinct()
    per_unit = distinct.groupBy(unit).agg(F.count("*").alias("n_samples"))
    n_units = per_unit.agg(F.count("*").alias("n_units"))
    seen = distinct.groupBy(sample).agg(F.count("*").alias("n"))
    common = seen.crossJoin(F.broadcast(n_units)).filter("n = n_units").select(sample)  # one row joins
    return distinct.select(sample).distinct(), common, per_unit


def value_counts(df: DataFrame, col: str, fractions: bool = False) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    if fractions:
        total = counts.agg(F.sum("n").alias("total"))
        counts = counts.crossJoin(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("total")).drop("total")
    return counts.orderBy(col)


def top_k(df: DataFrame, by: Sequence[str], n: int, per: Sequence[str] | None = None, ascending: bool = False) -> DataFrame:
    """First n rows by `by` (the first key in the given direction, the others ascending as ties)."""
    order = [F.col(by[0]).asc_nulls_last() if ascending else F.col(by[0]).desc_nulls_last(), *map(F.asc_nulls_last, by[1:])]
    if not per:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_order(col: str, order: Sequence[str]) -> Column:
    """Place of a category in `order`; others come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def multi_key_sort(df: DataFrame, keys: Sequence[str], custom_order: dict[str, Sequence[str]] | None = None) -> DataFrame:
    custom = custom_order or {}
    return df.orderBy(*[category_order(k, custom[k]) if k in custom else F.col(k) for k in keys])


def natural_chrom(col: str) -> list[Column]:
    """Sort keys of chromosome names: the number, then names without one."""
    number = F.expr(f"try_cast(regexp_extract({col}, '([0-9]+)$', 1) as int)")
    return [number.asc_nulls_last(), F.col(col)]


def chrom_split_report(intervals: DataFrame) -> DataFrame:
    return intervals.select("chrom", "split").distinct().orderBy(*natural_chrom("chrom"), "split")


def cap_rows(df: DataFrame, n: int, per: str = "split", order: Sequence[str] = ("ID", "rev_comp")) -> DataFrame:
    w = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def dice(seed: int | str, *keys: str | Column) -> Column:
    """Deterministic 32-bit number from a seed and keys: the first eight hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k if isinstance(k, Column) else F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sample_loci(df: DataFrame, n_loci: int, seed: int, key: str = "ID") -> DataFrame:
    """All rows of n ids chosen by hash order; all ids if there are no more than n."""
    ids = df.select(key).distinct().orderBy(dice(seed, key), key).limit(n_loci)
    return df.join(ids, key, "left_semi")


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: min, median, max, distinct values."""
    out = None
    for c in cols:
        rows = df.select(F.col(c).cast("double").alias("x")).filter(present("x"))
        ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.countDistinct("x").alias("n_distinct"))
        one = join_same(ends, exact_quantiles(rows, "x", {"median": 0.5}), ()).select(F.lit(c).alias("name"), "lo", "median", "hi", "n_distinct")
        out = one if out is None else out.unionByName(one)
    return out


def strand_completeness(df: DataFrame, id: str = "id", rc: str = "rev_comp") -> tuple[DataFrame, DataFrame]:
    """(ids with both strands, ids that lack one)."""
    both = df.groupBy(id).agg(F.bool_or(F.col(rc)).alias("has_rc"), F.bool_or(~F.col(rc)).alias("has_fwd"))
    ok = F.col("has_rc") & F.col("has_fwd")
    return both.filter(ok).select(id), both.filter(~F.coalesce(ok, F.lit(False))).select(id)
