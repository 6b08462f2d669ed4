"""Interval operators on 0-based half-open ranges.

Range joins are equi-joins on (chrom, level, cell). Cells of a level are eight times as wide as those of the one below, and
an interval lives on the finest level on which it touches few cells, so it makes few rows whatever its length. Of a pair,
the interval on the finer level asks the cells that it touches on the other's level; the overlap is checked as a residual,
and a pair counts only in the first cell that both touch, so no pair appears twice. Only levels that the other side has
are asked, which a small job finds out while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

#: Levels, and cells that an interval touches on its own level at most (and one more).
LEVELS, CELLS = 8, 16
PRIORITY = ("train", "val", "test")


def merge_intervals(regions: DataFrame, bin_bp: int = 1 << 20) -> DataFrame:
    """Per chromosome, intervals merged while a start lies below the running end (touching ones stay apart).

    The running end is taken within position bins and carried over the bins by their maxima, so a
    chromosome is not one task's work. An interval ends where the running end stands at the next one that opens, so rows of
    equal start and end may come in any order.
    """
    r = regions.select("chrom", "start", "end").withColumn("bin", F.floor(F.col("start") / bin_bp))
    chrom = Window.partitionBy("chrom")
    tops = r.groupBy("chrom", "bin").agg(F.max("end").alias("top"))
    before = chrom.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("chrom", "bin", F.max("top").over(before).alias("carried"), F.max("top").over(chrom).alias("last"))
    within = Window.partitionBy("chrom", "bin").orderBy("start", "end")
    seen = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    opened = r.join(tops, ["chrom", "bin"]).withColumn("seen", F.greatest(seen, "carried")).filter(F.coalesce(F.col("start") >= F.col("seen"), F.lit(True)))
    later = opened.groupBy("chrom", "bin").agg(F.min("seen").alias("first"))
    later = later.select("chrom", "bin", F.lead("first").over(chrom.orderBy("bin")).alias("later"))
    near = F.lead("seen").over(Window.partitionBy("chrom", "bin").orderBy("start", "end", "seen"))
    ends = opened.withColumn("near", near).join(later, ["chrom", "bin"])
    return ends.select("chrom", "start", F.when(F.col("end").isNotNull(), F.coalesce("near", "later", "last")).alias("end"))


def _level(start: Column, end: Column, bin_bp: int) -> Column:
    length = end - start
    out = F.lit(0)
    for i in range(LEVELS - 1):
        out = out + (length > CELLS * bin_bp * 8**i).cast("int")
    return out


def _width(level: Column, bin_bp: int) -> Column:
    return F.lit(bin_bp).cast("long") * F.pow(F.lit(8), level).cast("long")


def _cells(start: Column, end: Column, width: Column) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def _levels(df: DataFrame, start: str, end: str, bin_bp: int) -> list[int]:
    """The levels that intervals live on: LEVELS rows at most reach the driver."""
    return sorted(r[0] for r in df.select(_level(F.col(start), F.col(end), bin_bp).alias("l")).distinct().collect() if r[0] is not None)


def _at_home(df: DataFrame, start: str, end: str, bin_bp: int) -> DataFrame:
    """`df` once for each cell (_level, _cell) that an interval touches on its own level."""
    rows = df.withColumn("_level", _level(F.col(start), F.col(end), bin_bp))
    return rows.withColumn("_cell", F.explode(_cells(F.col(start), F.col(end), _width(F.col("_level"), bin_bp))))


def _asking(df: DataFrame, start: str, end: str, bin_bp: int, levels: Sequence[int], above: bool) -> DataFrame:
    """`df` once for each cell that an interval touches on those of `levels` that lie above its own (or are its own, unless `above`)."""
    own = _level(F.col(start), F.col(end), bin_bp)
    each = F.array(*[
        F.when((own < k) if above else (own <= k), F.transform(_cells(F.col(start), F.col(end), _width(F.lit(k), bin_bp)), lambda c: F.struct(F.lit(k).alias("_level"), c.alias("_cell")))) for k in levels or [0]  # noqa: B023
    ])
    return df.withColumn("_c", F.explode(F.flatten(F.filter(each, lambda x: x.isNotNull())))).select(*df.columns, "_c._level", "_c._cell")


def _meet(query: DataFrame, regions: DataFrame, start: str, end: str, bin_bp: int, how: str) -> DataFrame:
    """Join of `query` with `regions`, whose columns are r_<name>, once for each overlapping pair."""
    above, below = _levels(regions, "r_start", "r_end", bin_bp), _levels(query, start, end, bin_bp)
    sides = [(_asking(query, start, end, bin_bp, above, False), _at_home(regions, "r_start", "r_end", bin_bp))]
    higher = [k for k in below if above and k > above[0]]
    if higher:  # queries on a higher level than some region
        sides.append((_at_home(query, start, end, bin_bp), _asking(regions, "r_start", "r_end", bin_bp, higher, True)))
    out = None
    for q, r in sides:
        r = r.withColumnsRenamed({"_level": "_r_level", "_cell": "_r_cell"})
        met = (
            (F.col("chrom") == F.col("r_chrom")) & (F.col("_level") == F.col("_r_level")) & (F.col("_cell") == F.col("_r_cell"))
            & (F.col("r_start") < F.col(end)) & (F.col("r_end") > F.col(start))
        )
        if how == "inner":
            met = met & (F.col("_cell") == F.floor(F.greatest(start, "r_start") / _width(F.col("_level"), bin_bp)))
        one = q.join(r, met, how).drop("_level", "_cell", "_r_level", "_r_cell")
        out = one if out is None else out.unionByName(one)
    return out


def overlap_pairs(query: DataFrame, regions: DataFrame, start: str = "str_start", end: str = "str_end", bin_bp: int = 4096) -> DataFrame:
    """Every overlapping pair once: the columns of `query`, then those of `regions` as r_<name>. Both are read once while the plan is built."""
    return _meet(query, regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns]), start, end, bin_bp, "inner")


def overlapping_ids(query: DataFrame, regions: DataFrame, key: str = "id", start: str = "str_start", end: str = "str_end", bin_bp: int = 4096) -> DataFrame:
    """Distinct keys of the query rows that overlap any region; regions are merged first, by a job of this call."""
    r = stored(merge_intervals(regions).select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end")))
    return _meet(query.select(key, "chrom", start, end), r, start, end, bin_bp, "left_semi").select(key).distinct()


def overlaps_any(query: DataFrame, regions: DataFrame, key: str = "id", **kw) -> DataFrame:
    hits = overlapping_ids(query, regions, key, **kw).withColumn("overlaps", F.lit(True))
    return query.join(hits, key, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def overlap_flags(query: DataFrame, regions: DataFrame, class_col: str, classes: Sequence[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(query with a flag per region class, one row per class with count and percent)."""
    pairs = overlap_pairs(query.select(key, "chrom", "str_start", "str_end"), regions)
    hits = pairs.groupBy(key).agg(*[F.bool_or(F.col(f"r_{class_col}") == c).alias(f"in_{c}") for c in classes])
    flagged = query.join(hits, key, "left").withColumns({f"in_{c}": F.coalesce(f"in_{c}", F.lit(False)) for c in classes})
    stats = flagged.agg(F.array(*[
        F.struct(F.lit(c).alias("region_class"), F.count_if(F.col(f"in_{c}")).alias("n"), (100.0 * F.count_if(F.col(f"in_{c}")) / F.nullif(F.count("*"), F.lit(0))).alias("percent"))
        for c in classes
    ]).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return flagged, stats


def exclude_overlapping(query: DataFrame, regions: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that overlap no region, one row with the counts)."""
    hits = overlapping_ids(query, regions, key)
    stats = query.join(hits.withColumn("hit", F.lit(1)), key, "left").agg(
        F.count("hit").alias("n_excluded"), (F.count("*") - F.count("hit")).alias("n_kept")
    )
    return query.join(hits, key, "left_anti"), stats


def split_by_chrom(df: DataFrame, mapping: dict[str, str] | None = None, default: str = "train") -> DataFrame:
    split = F.lit(default)
    for chrom, name in (mapping or {"chr13": "val", "chr14": "test"}).items():
        split = F.when(F.col("chrom") == chrom, name).otherwise(split)
    return df.withColumn("split", split)


def split_by_priority(df: DataFrame, split_regions: DataFrame, n_flank: int, priority: Sequence[str] = PRIORITY, default: str = "test", key: str = "id") -> DataFrame:
    """Split of the first priority among the regions that the flanked locus overlaps."""
    window = df.select(key, "chrom", (F.col("str_start") - n_flank).alias("w_start"), (F.col("str_end") + n_flank).alias("w_end"))
    pairs = overlap_pairs(window, split_regions, "w_start", "w_end")
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("r_split"))
    best = pairs.filter(place > 0).groupBy(key).agg(F.min(place).alias("place"))
    named = F.element_at(F.array(*map(F.lit, priority)), F.col("place").cast("int"))
    return df.join(best, key, "left").withColumn("split", F.coalesce(named, F.lit(default))).drop("place")


def split_summary(df: DataFrame) -> DataFrame:
    from .relational import value_counts

    return value_counts(df, "split", fractions=True)


def augment_rc(df: DataFrame) -> DataFrame:
    """Every row and its reverse-complement twin."""
    return df.withColumn("rev_comp", F.explode(F.array(F.lit(False), F.lit(True))))


def best_overlap(query: DataFrame, segments: DataFrame, key: str = "id", bin_bp: int = 4096) -> DataFrame:
    """Segment with the largest overlap (the first by start on ties) and its length; null and 0 in a gap."""
    pairs = overlap_pairs(query.select(key, "chrom", "str_start", "str_end"), segments, bin_bp=bin_bp)
    length = F.least("str_end", "r_end") - F.greatest("str_start", "r_start")
    best = pairs.groupBy(key).agg(F.max_by(F.struct("r_segment_name", length.alias("overlap_bp")), F.struct(length, -F.col("r_start"))).alias("b"))
    return query.join(best, key, "left").select(
        *query.columns, F.col("b.r_segment_name").alias("segment_name"), F.coalesce("b.overlap_bp", F.lit(0)).cast("long").alias("overlap_bp")
    )


def annotate_state(df: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their state's group, one row with how many had none); the state is the name after its first underscore."""
    name = F.regexp_extract("segment_name", r"^[^_]*_(.*)$", 1)
    named = df.withColumn("state", F.when(F.col("segment_name").contains("_"), name)).join(states, "state", "left")
    dropped = named.agg(F.count_if(F.col("group").isNull()).alias("n_unassigned"), F.count("group").alias("n_assigned"))
    return named.filter("group is not null"), dropped
