"""Queries of the relational, cohort and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, intervals, relational
from . import derive as d
from .derive import sql
from .registry import query, rounded

PRIORITY_SQL = (
    "w AS (SELECT l.*, (SELECT min(CASE r.split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) FROM regions r WHERE r.chrom = l.chrom AND r.\"start\" < l.str_end + 100 AND r.\"end\" > l.str_start - 100) AS p FROM {src} l), "
    "s AS (SELECT * EXCLUDE (p), CASE p WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM w)"
)
_HIT = "EXISTS (SELECT 1 FROM regions r WHERE r.chrom = l.chrom AND r.\"start\" < l.str_end AND r.\"end\" > l.str_start{})"


@query("usable_loci_by_split", sql(
    ", ok AS (SELECT * FROM loci l WHERE NOT " + _HIT.format(" AND r.region_class = 'R'") + "), " + PRIORITY_SQL.format(src="ok")
    + " SELECT split, rev_comp, count(*) AS n FROM s, (SELECT unnest([false, true]) AS rev_comp) GROUP BY ALL", "loci", "regions"))
def usable_loci_by_split(spark, sf):
    regions = d.regions(spark, sf)
    kept, _ = intervals.exclude_overlapping(d.loci(spark, sf), regions.filter("region_class = 'R'"))
    split = intervals.split_by_priority(kept, regions.select("chrom", "start", "end", "split"), 100)
    return intervals.augment_rc(split).groupBy("split", "rev_comp").agg(F.count("*").alias("n"))


@query("filter_loci", sql("SELECT id, chrom, numcalled FROM stats WHERE motif_len = 2 AND numcalled >= 2000 AND split = 'train' AND NOT rev_comp", "stats"))
def filter_loci(spark, sf):
    return relational.filter_loci(d.stats(spark, sf), 2, 2000, "train", True)[0].select("id", "chrom", "numcalled")


@query("filter_loci_counters", sql("SELECT count(*) AS n_before, count(*) FILTER (motif_len = 2 AND numcalled >= 2000) AS n_after FROM stats", "stats"))
def filter_loci_counters(spark, sf):
    return relational.filter_loci(d.stats(spark, sf), 2)[1]


@query("filter_autosomes", sql("SELECT id, chrom FROM stats WHERE chrom NOT IN ('chr23', 'chr24')", "stats"))
def filter_autosomes(spark, sf):
    return relational.filter_autosomes(d.stats(spark, sf)).select("id", "chrom")


@query("rename_carry_labels", sql("SELECT id AS ID, het AS heterozygosity, mode AS mode_copy_number, numcalled AS num_called_total FROM stats", "stats"))
def rename_carry_labels(spark, sf):
    raw = d.stats(spark, sf).select("id", F.col("het").alias("het-1"), F.col("mode").alias("mode-1"), F.col("numcalled").alias("numcalled-1"))
    plain = relational.rename_carry_labels(raw, {})
    return relational.rename_carry_labels(plain, {"id": "ID", "het": "heterozygosity", "mode": "mode_copy_number", "numcalled": "num_called_total"}, "", ["ID"])


_ONE = ", l AS (SELECT chrom, \"start\", id FROM stats), r AS (SELECT 'chr' || (o_custkey % 23 + 1) AS chrom, o_orderkey * 40 AS \"start\", o_custkey AS cust FROM orders UNION ALL SELECT 'chr' || (o_custkey % 23 + 1), o_orderkey * 40, -1 FROM orders WHERE o_orderkey % 50 = 0), bad AS (SELECT chrom, \"start\" FROM r GROUP BY ALL HAVING count(*) > 1) "


def _right(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = [F.concat(F.lit("chr"), F.col("o_custkey") % 23 + 1).alias("chrom"), (F.col("o_orderkey") * 40).alias("start")]
    return o.select(*key, F.col("o_custkey").alias("cust")).unionByName(o.filter("o_orderkey % 50 = 0").select(*key, F.lit(-1).cast("long").alias("cust")))


def _one(spark, sf):
    return relational.one_to_one_join(d.stats(spark, sf).select("chrom", "start", "id"), _right(spark, sf), ["chrom", "start"])


@query("one_to_one_join", sql(_ONE + "SELECT chrom, \"start\", id, cust FROM l JOIN r USING (chrom, \"start\") WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.chrom = l.chrom AND b.\"start\" = l.\"start\")", "stats"))
def one_to_one_join(spark, sf):
    return _one(spark, sf)[0]


@query("one_to_one_duplicates", sql(_ONE + "SELECT chrom, \"start\", count(*) AS count, 'right' AS side FROM r GROUP BY ALL HAVING count(*) > 1", "stats"))
def one_to_one_duplicates(spark, sf):
    return _one(spark, sf)[1]


@query("one_to_one_unmatched", sql(_ONE + "SELECT chrom, \"start\", id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chrom = l.chrom AND r.\"start\" = l.\"start\")", "stats"))
def one_to_one_unmatched(spark, sf):
    return _one(spark, sf)[2]


@query("one_to_one_counters", sql(_ONE + ", lo AS (SELECT * FROM l ANTI JOIN bad USING (chrom, \"start\")), ro AS (SELECT * FROM r ANTI JOIN bad USING (chrom, \"start\")) SELECT (SELECT count(*) FROM lo JOIN ro USING (chrom, \"start\")) AS n_joined, (SELECT count(*) FROM lo ANTI JOIN ro USING (chrom, \"start\")) AS n_left_only, (SELECT count(*) FROM ro ANTI JOIN lo USING (chrom, \"start\")) AS n_right_only", "stats"))
def one_to_one_counters(spark, sf):
    return _one(spark, sf)[3]


def _ids(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 3 = 0").select(F.concat(F.lit("S"), F.col("c_custkey") + 5).alias("SampleID"))


_IDS = ", ids AS (SELECT 'S' || (c_custkey + 5) AS SampleID FROM customer WHERE c_custkey % 3 = 0) "


@query("keep_members", sql(_IDS + "SELECT SampleID, Sex FROM ped SEMI JOIN ids USING (SampleID)", "ped"))
def keep_members(spark, sf):
    return relational.keep_members(d.ped(spark, sf), _ids(spark, sf), "SampleID").select("SampleID", "Sex")


@query("missing_members", sql(_IDS + "SELECT SampleID FROM ids ANTI JOIN ped USING (SampleID)", "ped"))
def missing_members(spark, sf):
    return relational.missing_members(_ids(spark, sf), d.ped(spark, sf), "SampleID")


@query("attach_metadata", sql(", m AS (SELECT id, motif_len, split FROM preds QUALIFY row_number() OVER (PARTITION BY id ORDER BY motif_len, split) = 1), q AS (SELECT DISTINCT id FROM preds) SELECT q.id, m.motif_len, m.split FROM q LEFT JOIN m USING (id)", "preds"))
def attach_metadata(spark, sf):
    p = d.preds(spark, sf)
    return relational.attach_metadata(p.select("id").distinct(), p, "id", ["motif_len", "split"])


@query("map_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def map_lookup(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.map_lookup(spark.read.parquet(f"{sf}/customer.parquet"), nation, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("first_per_key", sql("SELECT chrom, id FROM loci QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY str_end DESC, id) = 1", "loci"))
def first_per_key(spark, sf):
    return relational.first_per_key(d.loci(spark, sf), ["chrom"], [F.desc("str_end"), "id"]).select("chrom", "id")


@query("concat_results", sql("SELECT id, chrom, NULL::VARCHAR AS split FROM loci UNION ALL SELECT id, NULL, split FROM preds", "loci", "preds"))
def concat_results(spark, sf):
    return relational.concat_results(d.loci(spark, sf).select("id", "chrom"), d.preds(spark, sf).select("id", "split"))


_SAMP = ", s AS (SELECT DISTINCT 'chr' || (l_linenumber % 3) AS chrom, l_suppkey AS sample FROM lineitem) "


def _samples(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("chr"), F.col("l_linenumber") % 3).alias("chrom"), F.col("l_suppkey").alias("sample"))
    return relational.sample_sets(rows)


@query("sample_sets", "WITH x AS (SELECT 1)" + _SAMP + "SELECT sample, count(*) = (SELECT count(DISTINCT chrom) FROM s) AS in_all FROM s GROUP BY sample")
def sample_sets(spark, sf):
    union, common, _ = _samples(spark, sf)
    return union.join(common.withColumn("in_all", F.lit(True)), "sample", "left").withColumn("in_all", F.coalesce("in_all", F.lit(False)))


@query("sample_set_sizes", "WITH x AS (SELECT 1)" + _SAMP + "SELECT chrom, count(*) AS n_samples FROM s GROUP BY chrom")
def sample_set_sizes(spark, sf):
    return _samples(spark, sf)[2]


@query("value_counts", sql("SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM preds), 6) AS fraction FROM preds GROUP BY split", "preds"))
def value_counts(spark, sf):
    return rounded(relational.value_counts(d.preds(spark, sf), "split", fractions=True))


@query("top_k", sql("SELECT motif_len, id, row_number() OVER (PARTITION BY motif_len ORDER BY numcalled DESC, id) AS rank FROM stats QUALIFY rank <= 10", "stats"))
def top_k(spark, sf):
    return relational.top_k(d.stats(spark, sf), ["numcalled", "id"], 10, ["motif_len"]).select("motif_len", "id", F.col("rank").cast("long").alias("rank"))


@query("multi_key_sort", sql("SELECT split, motif_len, id FROM stats ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, motif_len, id", "stats"))
def multi_key_sort(spark, sf):
    return relational.multi_key_sort(d.stats(spark, sf), ["split", "motif_len", "id"], {"split": ["train", "val", "test"]}).select("split", "motif_len", "id")


@query("chrom_split_report", sql("SELECT DISTINCT chrom, split FROM regions", "regions"))
def chrom_split_report(spark, sf):
    return relational.chrom_split_report(d.regions(spark, sf))


@query("cap_rows", sql("SELECT split, id, rev_comp FROM preds QUALIFY row_number() OVER (PARTITION BY split ORDER BY id, rev_comp) <= 100", "preds"))
def cap_rows(spark, sf):
    return relational.cap_rows(d.preds(spark, sf), 100, order=("id", "rev_comp")).select("split", "id", "rev_comp")


@query("sample_loci", sql(", c AS (SELECT DISTINCT id FROM preds ORDER BY ('0x' || substr(md5('7|' || id), 1, 8))::BIGINT, id LIMIT 200) SELECT id, rev_comp FROM preds SEMI JOIN c USING (id)", "preds"))
def sample_loci(spark, sf):
    return relational.sample_loci(d.preds(spark, sf), 200, 7, "id").select("id", "rev_comp")


@query("column_profile", sql("SELECT 'numcalled' AS name, min(numcalled)::DOUBLE AS lo, quantile_cont(numcalled::DOUBLE, 0.5) AS median, max(numcalled)::DOUBLE AS hi, count(DISTINCT numcalled) AS n_distinct FROM stats UNION ALL SELECT 'het', min(het)::DOUBLE, quantile_cont(het::DOUBLE, 0.5), max(het)::DOUBLE, count(DISTINCT het) FROM stats", "stats"))
def column_profile(spark, sf):
    return relational.column_profile(d.stats(spark, sf), ["numcalled", "het"])


@query("strand_completeness", sql("SELECT id, bool_or(rev_comp) AND bool_or(NOT rev_comp) AS complete FROM preds GROUP BY id", "preds"))
def strand_completeness(spark, sf):
    ok, bad = relational.strand_completeness(d.preds(spark, sf))
    return ok.withColumn("complete", F.lit(True)).unionByName(bad.withColumn("complete", F.lit(False)))


@query("genotype_locus_stats", sql(", a AS (SELECT locus, unnest([allele_1, allele_2]) AS allele FROM calls), c AS (SELECT locus, allele, count(*) AS n FROM a GROUP BY ALL) SELECT locus, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) AS heterozygosity, arg_max(allele, n * 1000 - allele) AS mode_allele, (sum(n) // 2)::BIGINT AS numcalled FROM c GROUP BY locus", "calls"))
def genotype_locus_stats(spark, sf):
    samples = d.calls(spark, sf).select("sample").distinct()
    return rounded(cohort.genotype_locus_stats(d.calls(spark, sf), samples))


_KEPT = ", kept AS (SELECT * FROM ped WHERE NOT (FatherID <> '0' OR MotherID <> '0') AND SampleID IN (SELECT SampleID FROM ids)) "


@query("drop_trio_children", sql(_IDS + _KEPT + "SELECT i.SampleID, i.SampleID IN (SELECT SampleID FROM kept) AS kept FROM ids i", "ped"))
def drop_trio_children(spark, sf):
    kept, removed = cohort.drop_trio_children(d.ped(spark, sf), _ids(spark, sf))
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))


@query("cohort_counts", sql("SELECT CASE Sex WHEN '1' THEN 'male' WHEN '2' THEN 'female' ELSE 'unknown' END AS value, count(*) AS n FROM ped GROUP BY 1 UNION ALL SELECT Superpopulation, count(*) FROM ped GROUP BY 1", "ped"))
def cohort_counts(spark, sf):
    p = d.ped(spark, sf)
    return cohort.cohort_counts(p, "Sex").withColumnRenamed("Sex", "value").unionByName(cohort.cohort_counts(p, "Superpopulation").withColumnRenamed("Superpopulation", "value"))


@query("motif_length_counts", sql("SELECT motif_len, count(*) AS n FROM stats GROUP BY ROLLUP (motif_len)", "stats"))
def motif_length_counts(spark, sf):
    return cohort.motif_length_counts(d.stats(spark, sf))


@query("to_half_open", sql("SELECT id, \"start\" - 1 AS \"start\", \"end\" FROM stats", "stats"))
def to_half_open(spark, sf):
    return cohort.to_half_open(d.stats(spark, sf)).select("id", "start", "end")


@query("motif_unit_length", sql("SELECT count(DISTINCT motif_len) AS n_lengths, count(*) FILTER (motif_len <> 2) AS n_mismatch, count(DISTINCT motif_len) <= 1 AS uniform FROM stats", "stats"))
def motif_unit_length(spark, sf):
    rows = d.stats(spark, sf).withColumns({"str_start": F.col("start"), "str_end": F.col("end"), "motif": F.lit("AC")})
    return cohort.motif_unit_length(rows)[1]


@query("merge_intervals", sql(", m AS (SELECT *, max(\"end\") OVER (PARTITION BY chrom ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM regions), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR \"start\" >= seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chrom, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM g GROUP BY chrom, island", "regions"))
def merge_intervals(spark, sf):
    return intervals.merge_intervals(d.regions(spark, sf), 1 << 14)


@query("overlaps_any", sql("SELECT id, " + _HIT.format("") + " AS overlaps FROM loci l", "loci", "regions"))
def overlaps_any(spark, sf):
    return intervals.overlaps_any(d.loci(spark, sf), d.regions(spark, sf)).select("id", "overlaps")


_FLAGS = ", ".join(f"{_HIT.format(f' AND r.region_class = {chr(39)}{c}{chr(39)}')} AS in_{c}" for c in "ANR")


@query("overlap_flags", sql(f"SELECT id, {_FLAGS} FROM loci l", "loci", "regions"))
def overlap_flags(spark, sf):
    return intervals.overlap_flags(d.loci(spark, sf), d.regions(spark, sf), "region_class", list("ANR"))[0].select("id", "in_A", "in_N", "in_R")


@query("overlap_flag_stats", sql(f", f AS (SELECT id, {_FLAGS} FROM loci l) " + " UNION ALL ".join(f"SELECT '{c}' AS region_class, count(*) FILTER (in_{c}) AS n, round(100.0 * count(*) FILTER (in_{c}) / count(*), 6) AS percent FROM f" for c in "ANR"), "loci", "regions"))
def overlap_flag_stats(spark, sf):
    return rounded(intervals.overlap_flags(d.loci(spark, sf), d.regions(spark, sf), "region_class", list("ANR"))[1])


@query("exclude_overlapping", sql("SELECT id, chrom FROM loci l WHERE NOT " + _HIT.format(""), "loci", "regions"))
def exclude_overlapping(spark, sf):
    return intervals.exclude_overlapping(d.loci(spark, sf), d.regions(spark, sf))[0].select("id", "chrom")


@query("exclude_overlapping_counts", sql(", h AS (SELECT " + _HIT.format("") + " AS hit FROM loci l) SELECT count(*) FILTER (hit) AS n_excluded, count(*) FILTER (NOT hit) AS n_kept FROM h", "loci", "regions"))
def exclude_overlapping_counts(spark, sf):
    return intervals.exclude_overlapping(d.loci(spark, sf), d.regions(spark, sf))[1]


@query("split_by_chrom", sql("SELECT id, CASE chrom WHEN 'chr13' THEN 'val' WHEN 'chr14' THEN 'test' ELSE 'train' END AS split FROM loci", "loci"))
def split_by_chrom(spark, sf):
    return intervals.split_by_chrom(d.loci(spark, sf)).select("id", "split")


@query("split_by_priority", sql(", " + PRIORITY_SQL.format(src="loci") + " SELECT id, split FROM s", "loci", "regions"))
def split_by_priority(spark, sf):
    return intervals.split_by_priority(d.loci(spark, sf), d.regions(spark, sf).select("chrom", "start", "end", "split"), 100).select("id", "split")


@query("split_summary", sql(", " + PRIORITY_SQL.format(src="loci") + " SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS fraction FROM s GROUP BY split", "loci", "regions"))
def split_summary(spark, sf):
    rows = intervals.split_by_priority(d.loci(spark, sf), d.regions(spark, sf).select("chrom", "start", "end", "split"), 100)
    return rounded(intervals.split_summary(rows))


@query("augment_rc", sql("SELECT id, rev_comp FROM loci, (SELECT unnest([false, true]) AS rev_comp)", "loci"))
def augment_rc(spark, sf):
    return intervals.augment_rc(d.loci(spark, sf)).select("id", "rev_comp")


_BEST = ", o AS (SELECT l.id, g.segment_name, least(l.str_end, g.\"end\") - greatest(l.str_start, g.\"start\") AS overlap_bp FROM loci l JOIN segments g ON g.chrom = l.chrom AND g.\"start\" < l.str_end AND g.\"end\" > l.str_start QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY overlap_bp DESC, g.\"start\") = 1), b AS (SELECT l.id, o.segment_name, coalesce(o.overlap_bp, 0) AS overlap_bp FROM loci l LEFT JOIN o USING (id)) "


@query("best_overlap", sql(_BEST + "SELECT id, segment_name, overlap_bp FROM b", "loci", "segments"))
def best_overlap(spark, sf):
    return intervals.best_overlap(d.loci(spark, sf), d.segments(spark, sf)).select("id", "segment_name", "overlap_bp")


def _states(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("state")).distinct()
    return events.filter("state <> 'click'").withColumn("group", F.upper(F.left("state", F.lit(1))))


@query("annotate_state", sql(_BEST + "SELECT id, substr(segment_name, strpos(segment_name, '_') + 1) AS state, upper(substr(segment_name, strpos(segment_name, '_') + 1, 1)) AS \"group\" FROM b WHERE segment_name IS NOT NULL AND substr(segment_name, strpos(segment_name, '_') + 1) <> 'click'", "loci", "segments"))
def annotate_state(spark, sf):
    rows = intervals.best_overlap(d.loci(spark, sf), d.segments(spark, sf))
    return intervals.annotate_state(rows, _states(spark, sf))[0].select("id", "state", "group")
