"""Queries of attribution mining, and of readers and writers on files that Spark derives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as a
from ..operators import cohort
from ..operators import sequence as seq
from ..sources import tables as io
from . import derive as d
from .derive import sql
from .registry import query, rounded

_L = 24
_REL = "abs(delta) / CASE WHEN abs(pred - base) <= 1e-6 THEN 1.0 ELSE abs(pred - base) END"
_DELTA = "abs(delta)"
_SUMMARY = "count(*) AS n, " + ", ".join(
    f"round(avg({x}), 5) AS {c}_mean, round(max({x}), 5) AS {c}_max, round(stddev_pop({x}), 5) AS {c}_std, round(quantile_cont({x}, 0.5), 5) AS {c}_median" for c, x in (("delta", _DELTA), ("rel", _REL))
) + ", " + ", ".join(f"round(100.0 * count(*) FILTER ({_REL} > {x}) / count(*), 5) AS pct_over_{c}" for c, x in ((5, 0.05), (1, 0.01))) + (
    ", round(avg(pred - base), 5) AS diff_mean, round(min(pred - base), 5) AS diff_min, round(max(pred - base), 5) AS diff_max, round(quantile_cont(pred - base, 0.5), 5) AS diff_median"
)


@query("relative_delta", sql(f"SELECT id, rev_comp, round({_REL}, 6) AS rel FROM attr", "attr"))
def relative_delta(spark, sf):
    return rounded(d.attr(spark, sf).select("id", "rev_comp", a.relative_delta(F.col("delta"), F.col("pred") - F.col("base")).alias("rel")))


@query("convergence_summary", sql(f"SELECT task, {_SUMMARY} FROM attr GROUP BY task", "attr"))
def convergence_summary(spark, sf):
    return rounded(a.convergence_summary(d.attr(spark, sf)), 5)


@query("informative_summary", sql(f"SELECT task, abs(pred - base) > 0.75 AS informative, {_SUMMARY} FROM attr GROUP BY ALL", "attr"))
def informative_summary(spark, sf):
    return rounded(a.informative_summary(d.attr(spark, sf), 0.75), 5)


@query("method_sweep", sql(f"SELECT task, CASE WHEN rev_comp THEN 'gauss' ELSE 'riemann' END AS method, id % 3 AS n_steps, count(*) AS n, round(100.0 * count(*) FILTER ({_REL} > 0.05) / count(*), 5) AS pct_over FROM attr GROUP BY ALL", "attr"))
def method_sweep(spark, sf):
    rows = d.attr(spark, sf).withColumn("method", F.when(F.col("rev_comp"), "gauss").otherwise("riemann")).withColumn("n_steps", F.col("id") % 3)
    return rounded(a.method_sweep(rows), 5)


@query("filter_samples", sql(f"SELECT count(*) AS n_total, count(*) FILTER (abs(pred - base) <= 0.65) AS n_small_diff, count(*) FILTER (abs(pred - base) > 0.65 AND {_REL} > 0.08) AS n_rough, count(*) FILTER (abs(pred - base) > 0.65 AND {_REL} <= 0.08) AS n_kept FROM attr", "attr"))
def filter_samples(spark, sf):
    return a.filter_samples(d.attr(spark, sf), 0.65, 0.08)[1]


_PAIRS = ", p AS (SELECT id, max(CASE WHEN NOT rev_comp THEN pred END) AS fwd_pred, max(CASE WHEN rev_comp THEN pred END) AS rc_pred, max(CASE WHEN NOT rev_comp THEN attr END) AS f, max(CASE WHEN rev_comp THEN attr END) AS r, max(CASE WHEN NOT rev_comp THEN sequence END) AS sequence, max(CASE WHEN NOT rev_comp THEN motif_class END) AS motif_class, max(CASE WHEN NOT rev_comp THEN delta END) AS fd, max(CASE WHEN rev_comp THEN delta END) AS rd FROM attr GROUP BY id HAVING bool_or(rev_comp) AND bool_or(NOT rev_comp)) "


def _pairs(spark, sf):
    return a.pair_strands(d.attr(spark, sf), ["pred", "attr", "sequence", "motif_class", "delta"])


@query("pair_strands", sql(_PAIRS + "SELECT id, round(fwd_pred, 6) AS fwd_pred, round(rc_pred, 6) AS rc_pred, round(list_sum(f), 4) AS fwd_attr, round(list_sum(r), 4) AS rc_attr, sequence AS fwd_sequence, motif_class AS fwd_motif_class, round(fd, 6) AS fwd_delta, round(rd, 6) AS rc_delta FROM p", "attr"))
def pair_strands(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4).alias(c)
    return rounded(_pairs(spark, sf).select("id", "fwd_pred", "rc_pred", total("fwd_attr"), total("rc_attr"), "fwd_sequence", "fwd_motif_class", "fwd_delta", "rc_delta"))


@query("segment_labels", sql("SELECT id, rev_comp, CASE WHEN i <= 24 THEN 'left_flank' WHEN i <= 32 THEN 'left_str' WHEN i <= 40 THEN 'right_str' ELSE 'right_flank' END AS segment, count(*) AS n, round(sum(abs(attr[i])), 4) AS total FROM attr, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL", "attr"))
def segment_labels(spark, sf):
    """Attribution by segment of the model's input."""
    rows = d.attr(spark, sf).select("id", "rev_comp", F.explode(F.arrays_zip(seq.segment_labels(24, 8).alias("segment"), F.col("attr"))).alias("x"))
    return rows.groupBy("id", "rev_comp", F.col("x.segment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs("x.attr")), 4).alias("total"))


@query("normalize_attr", sql("SELECT id, rev_comp, i, round(attr[i] / (pred - base), 5) AS x FROM attr, (SELECT unnest(range(1, 65)) AS i)", "attr"))
def normalize_attr(spark, sf):
    rows = d.attr(spark, sf).withColumn("x", a.normalize_attr(F.col("attr"), F.col("pred") - F.col("base")))
    return rounded(rows.select("id", "rev_comp", F.posexplode("x").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long")), 5)


_AVG = _PAIRS + f", v AS (SELECT *, list_transform(range(1, {_L + 1}), lambda i: (f[i] + r[65 - i]) / 2) AS \"left\", list_transform(range(1, {_L + 1}), lambda i: (f[{64 - _L} + i] + r[{_L + 1} - i]) / 2) AS \"right\" FROM p) "


def _averaged(spark, sf):
    return a.strand_average(_pairs(spark, sf), _L, _L).withColumnRenamed("fwd_sequence", "sequence").withColumnRenamed("fwd_motif_class", "motif_class")


@query("strand_average", sql(_AVG + f"SELECT id, i, round(\"left\"[i], 6) AS left_x, round(\"right\"[i], 6) AS right_x FROM v, (SELECT unnest(range(1, {_L + 1})) AS i)", "attr"))
def strand_average(spark, sf):
    rows = _averaged(spark, sf).select("id", F.posexplode(F.arrays_zip("left", "right")).alias("i", "s"))
    return rounded(rows.select("id", (F.col("i") + 1).cast("long").alias("i"), F.col("s.left").alias("left_x"), F.col("s.right").alias("right_x")))


@query("position_profile", sql("SELECT i - 1 AS pos, round(avg(abs(attr[i])), 6) AS mean_abs, count(*) AS n FROM attr, (SELECT unnest(range(1, 65)) AS i) GROUP BY i", "attr"))
def position_profile(spark, sf):
    return rounded(a.position_profile(d.attr(spark, sf)).withColumn("pos", F.col("pos").cast("long")))


def _profile(spark, sf):
    p = a.position_profile(d.attr(spark, sf))
    axis = a.relative_axis(F.col("pos"), _L, 64 - 2 * _L)
    return p.withColumn("axis", axis.cast("long")).filter("axis is not null").withColumn("flank", F.when(F.col("axis") < 0, "left").otherwise("right"))


_PROFILE = f", p AS (SELECT i - 1 AS pos, avg(abs(attr[i])) AS m FROM attr, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), x AS (SELECT *, CASE WHEN pos < {_L} THEN pos - {_L} WHEN pos >= {64 - _L} THEN pos - {64 - _L} + 1 END AS axis FROM p) "


@query("relative_axis", sql(_PROFILE + "SELECT axis, round(m, 6) AS mean_abs FROM x WHERE axis IS NOT NULL", "attr"))
def relative_axis(spark, sf):
    return rounded(_profile(spark, sf).select("axis", "mean_abs"))


@query("smooth_profile", sql(_PROFILE + "SELECT axis, round(sum(m) OVER (PARTITION BY axis < 0 ORDER BY axis ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM x WHERE axis IS NOT NULL", "attr"))
def smooth_profile(spark, sf):
    return rounded(a.smooth_profile(_profile(spark, sf), 5).select("axis", "smooth"))


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query("kmer_occurrences", sql(_AVG + f", o AS (SELECT d AS distance, motif_class, list_sum(\"left\"[{_L} - d - 3:{_L} - d + 1]) / 5 AS s, substr(sequence, {_L} - d - 3, 5) AS w FROM v, (SELECT unnest(range(1, 21)) AS d) UNION ALL SELECT d, motif_class, list_sum(\"right\"[d:d + 4]) / 5, substr(sequence, {64 - _L} + d, 5) FROM v, (SELECT unnest(range(1, 21)) AS d)) SELECT distance::INT AS distance, least(w, {_RC.format('w')}) AS kmer, motif_class, count(*) AS n, round(sum(s), 5) AS score FROM o GROUP BY ALL", "attr"))
def kmer_occurrences(spark, sf):
    rows = a.kmer_occurrences(_averaged(spark, sf), 5, _L, _L)
    return rounded(rows.groupBy("distance", "kmer", "motif_class").agg(F.count("*").alias("n"), F.sum("ig_score").alias("score")), 5)


@query("rank_candidates", sql(_PAIRS + ", c AS (SELECT id, 'length' AS task, greatest(fd, rd) AS delta, fd + rd AS error, least(fwd_pred, rc_pred) - 1.5 AS diff FROM p), k AS (SELECT * FROM c WHERE diff >= 0.55), s AS (SELECT id, ((row_number() OVER (ORDER BY error DESC, id) - 1) * 1.0 + (row_number() OVER (ORDER BY delta DESC, id) - 1) + 5.0 * (row_number() OVER (ORDER BY diff, id) - 1)) / (count(*) OVER () - 1) / 7 AS score FROM k) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20", "attr"))
def rank_candidates(spark, sf):
    p = _pairs(spark, sf).select("id", F.lit("length").alias("task"), F.greatest("fwd_delta", "rc_delta").alias("delta"), (F.col("fwd_delta") + F.col("rc_delta")).alias("error"), (F.least("fwd_pred", "rc_pred") - 1.5).alias("diff"))
    return rounded(a.rank_candidates(p, min_diff=0.55).select("id", "score"))


@query("logo_matrix", sql(_AVG + f", b AS (SELECT i - {_L + 1} AS pos, \"left\"[i] AS x, substr(sequence, i, 1) AS c FROM v, (SELECT unnest(range(1, {_L + 1})) AS i) WHERE id = 10 UNION ALL SELECT i, \"right\"[i], substr(sequence, {64 - _L} + i, 1) FROM v, (SELECT unnest(range(1, {_L + 1})) AS i) WHERE id = 10 UNION ALL SELECT 0, 0.0, '-') SELECT pos, " + ", ".join(f"round(CASE WHEN c = '{x}' THEN x ELSE 0 END, 6) AS {x}" for x in "ACGT") + " FROM b WHERE abs(pos) <= 20", "attr"))
def logo_matrix(spark, sf):
    return rounded(a.logo_matrix(_averaged(spark, sf), 10, _L, _L, 20).withColumn("pos", F.col("pos").cast("long")))


_SCOPES = ", sc AS (SELECT k.*, scope, w AS \"window\" FROM kmers k, LATERAL (SELECT unnest(['all', 'motif_' || k.motif_class]) AS scope), LATERAL (SELECT unnest(['global', CASE WHEN distance BETWEEN 1 AND 3 THEN '1-3' END, CASE WHEN distance BETWEEN 3 AND 6 THEN '3-6' END]) AS w) WHERE w IS NOT NULL) "


def _scoped(spark, sf):
    return a.enrichment_scopes(d.kmers(spark, sf), True, [(1, 3), (3, 6)])


@query("enrichment_scopes", sql(_SCOPES + "SELECT scope, \"window\", count(*) AS n, count(DISTINCT kmer) AS n_kmers FROM sc GROUP BY ALL", "kmers"))
def enrichment_scopes(spark, sf):
    return _scoped(spark, sf).groupBy("scope", "window").agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("n_kmers"))


_WINDOWS = [(1, 3), (3, 6)]
_STORED = ", st AS (SELECT kmer, distance, motif_class, ig_score::FLOAT::DOUBLE AS ig_score FROM kmers), w AS (SELECT st.*, scope, w AS \"window\" FROM st, LATERAL (SELECT unnest(['all', 'motif_' || motif_class]) AS scope), LATERAL (SELECT unnest([CASE WHEN distance BETWEEN 1 AND 3 THEN '1-3' END, CASE WHEN distance BETWEEN 3 AND 6 THEN '3-6' END]) AS w) WHERE w IS NOT NULL), wr AS (SELECT *, rank() OVER (PARTITION BY scope, \"window\", distance ORDER BY ig_score) + (count(*) OVER (PARTITION BY scope, \"window\", distance, ig_score) - 1) / 2.0 AS r, avg(ig_score) OVER (PARTITION BY scope, \"window\", distance) AS pool FROM w) "


def _ordered(spark, sf):
    return io.write_kmers(d.kmers(spark, sf), _folder(spark))


@query("enrichment_windows", sql(_STORED + "SELECT scope, \"window\", kmer, count(*) AS n_occurrences, round(avg(r), 5) AS observed_mean, round(avg(ig_score), 5) AS raw_observed, round(avg(pool), 5) AS raw_expected FROM wr GROUP BY ALL", "kmers"))
def enrichment_windows(spark, sf):
    by = ["scope", "window"]
    rows = a.enrichment_scopes(_ordered(spark, sf), True, _WINDOWS, whole=False)
    ranked = a.processed_scores(rows, [*by, "distance"]).groupBy(*by, "kmer").agg(F.count("*").alias("n_occurrences"), F.avg("score").alias("observed_mean"))
    return rounded(ranked.join(a.raw_effect(rows, by), [*by, "kmer"]), 5)


@query("enrichment_run")
def enrichment_run(spark, sf):
    return rounded(a.enrichment_run(_ordered(spark, sf), True, _WINDOWS, _N_PERM), 5)


#: Permutations of the reference's k-mer enrichment; SQL is too slow for them, the tests compare with brute force.
_N_PERM = 10_000


def _perm(spark, sf):
    return a.stratified_permutation(d.kmers(spark, sf), _N_PERM)


@query("stratified_permutation")
def stratified_permutation(spark, sf):
    return rounded(a.null_rows(_perm(spark, sf)[1]), 5)


@query("permutation_pvalues")
def permutation_pvalues(spark, sf):
    observed, null = _perm(spark, sf)
    return rounded(a.permutation_pvalues(observed, null, use_absolute=True).select("kmer", "n_occurrences", "p_value"))


@query("raw_effect", sql(", p AS (SELECT distance, avg(ig_score) AS pool FROM kmers GROUP BY distance) SELECT kmer, round(avg(ig_score), 5) AS raw_observed, round(avg(pool), 5) AS raw_expected FROM kmers JOIN p USING (distance) GROUP BY kmer", "kmers"))
def raw_effect(spark, sf):
    return rounded(a.raw_effect(d.kmers(spark, sf)), 5)


_P = ", e AS (SELECT scope, kmer || '_' || distance AS kmer, count(*) AS n, avg(ig_score) AS raw_observed, 100.0 AS raw_expected, (count(*) % 23 + 1) / 500.0 AS p_value FROM sc WHERE \"window\" = 'global' GROUP BY ALL), ad AS (SELECT *, count(*) OVER (PARTITION BY scope ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER (PARTITION BY scope) AS m FROM e), bh AS (SELECT *, least(min(p_value * m / rk) OVER (PARTITION BY scope ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING), 1) AS bh, least(p_value * m, 1) AS bf, raw_observed - raw_expected AS es FROM ad), th AS (SELECT scope, quantile_cont(abs(es), 0.9) AS t FROM bh GROUP BY scope) "


def _results(spark, sf):
    rows = _scoped(spark, sf).filter("window = 'global'").groupBy("scope", F.concat_ws("_", "kmer", "distance").alias("kmer"))
    return rows.agg(F.count("*").alias("n"), F.avg("ig_score").alias("raw_observed")).withColumn("raw_expected", F.lit(100.0)).withColumn("p_value", (F.col("n") % 23 + 1) / 500.0)


@query("adjust_pvalues", sql(_SCOPES + _P + "SELECT scope, kmer, round(bh, 6) AS p_adj_fdr_bh, round(bf, 6) AS p_adj_bonferroni FROM bh", "kmers"))
def adjust_pvalues(spark, sf):
    return rounded(a.adjust_pvalues(_results(spark, sf), per=["scope"]).select("scope", "kmer", "p_adj_fdr_bh", "p_adj_bonferroni"))


def _dual(spark, sf):
    return a.dual_significance(_results(spark, sf), 0.02, 90.0)


@query("dual_significance", sql(_SCOPES + _P + "SELECT scope, kmer, round(bh, 6) AS p_adj_fdr_bh, round(bf, 6) AS p_adj_bonferroni, round(es, 3) AS effect_size, round(100 * (rank() OVER (PARTITION BY scope ORDER BY es) + (count(*) OVER (PARTITION BY scope, es) - 1) / 2.0) / m, 5) AS effect_percentile, bh < 0.02 AS sig_fdr, abs(es) > t AS sig_effect, bh < 0.02 AND abs(es) > t AS sig_dual FROM bh JOIN th USING (scope)", "kmers"))
def dual_significance(spark, sf):
    cols = _dual(spark, sf).withColumns({"effect_size": F.round("effect_size", 3), "effect_percentile": F.round("effect_percentile", 5)})
    return rounded(cols.select("scope", "kmer", "p_adj_fdr_bh", "p_adj_bonferroni", "effect_size", "effect_percentile", "sig_fdr", "sig_effect", "sig_dual"))


_ALPHAS = (0.05, 0.02, 0.004)


@query("significance_counts", sql(_SCOPES + _P + "SELECT scope, alpha, count(*) AS n, count(*) FILTER (bh < alpha) AS n_fdr, count(*) FILTER (bf < alpha) AS n_bonferroni, count(*) FILTER (bh < alpha AND abs(es) > t) AS n_dual FROM bh JOIN th USING (scope), (SELECT unnest([0.05, 0.02, 0.004]::DOUBLE[]) AS alpha) GROUP BY ALL", "kmers"))
def significance_counts(spark, sf):
    return a.significance_counts(_dual(spark, sf), _ALPHAS)


@query("effect_histogram", sql(_SCOPES + _P + ", mm AS (SELECT scope, min(es) AS a, max(es) AS b FROM bh GROUP BY scope) SELECT scope, least(floor((es - a) / ((b - a) / 50)), 49)::BIGINT AS bin, round(a + least(floor((es - a) / ((b - a) / 50)), 49) * ((b - a) / 50), 4) AS lo, round(a + (least(floor((es - a) / ((b - a) / 50)), 49) + 1) * ((b - a) / 50), 4) AS hi, count(*) AS n, count(*) FILTER (abs(es) > t) AS n_large FROM bh JOIN th USING (scope) JOIN mm USING (scope) GROUP BY ALL", "kmers"))
def effect_histogram(spark, sf):
    return rounded(a.effect_histogram(_dual(spark, sf)), 4)


@query("significance_diagnostics", sql(_SCOPES + _P + "SELECT least(floor(p_value * 50), 49)::BIGINT AS bin, CASE WHEN bh < 0.02 AND abs(es) > t THEN 'dual' WHEN bh < 0.02 THEN 'fdr' ELSE 'none' END AS kind, count(*) AS n, round(max(-log10(greatest(bh, 1e-300))), 5) AS max_neg_log10 FROM bh JOIN th USING (scope) GROUP BY ALL", "kmers"))
def significance_diagnostics(spark, sf):
    return rounded(a.significance_diagnostics(_dual(spark, sf)), 5)


def _folder(spark) -> str:
    return io.scratch(spark)


@query("read_table", "SELECT o_orderkey AS id, 'chr' || (o_custkey % 22 + 1) AS chrom, o_orderkey % 100 AS n FROM orders")
def read_table(spark, sf):
    path = _folder(spark)
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1).alias("chrom"), (F.col("o_orderkey") % 100).alias("n"), F.lit("x").alias("other"))
    io.write_tsv(rows, path)
    return io.read_table(spark, path, "id long, chrom string, n long", ["chrom"], ["id", "chrom", "n"])


@query("read_bed", sql("SELECT chrom, \"start\", \"end\", split FROM regions", "regions"))
def read_bed(spark, sf):
    path = _folder(spark)
    rows = d.regions(spark, sf).select("chrom", "start", "end", F.when(F.col("split") == "val", "valid").otherwise(F.col("split")))
    rows.write.option("sep", "\t").csv(path)
    return io.read_bed(spark, path, ("chrom", "start", "end", "split"))


@query("read_pedigree", sql("SELECT replace(FamilyID, ' ', '_') AS FamilyID, SampleID, FatherID, MotherID, Sex, replace(Population, ' ', '_') AS Population, replace(Superpopulation, ' ', '_') AS Superpopulation FROM ped", "ped"))
def read_pedigree(spark, sf):
    path = _folder(spark)
    rows = d.ped(spark, sf)  # names hold spaces, which part the file's columns
    rows.select(F.concat(F.lit("  "), F.concat_ws("   ", *[F.replace(c, F.lit(" "), F.lit("_")) for c in rows.columns])).alias("value")).write.text(path)
    return io.read_pedigree(spark, path)


@query("read_id_list", "SELECT DISTINCT 'S' || (c_custkey % 700) AS SampleID FROM customer")
def read_id_list(spark, sf):
    path = _folder(spark)
    spark.read.parquet(f"{sf}/customer.parquet").select(F.explode(F.array(F.concat(F.lit(" S"), F.col("c_custkey") % 700, F.lit(" ")), F.lit(""))).alias("value")).write.text(path)
    return io.read_id_list(spark, path)


@query("read_fasta", sql("SELECT chrom, off // 512 AS chunk_idx, left(piece, 512) AS seq FROM pieces WHERE off = 0 OR piece <> ''", "pieces"))
def read_fasta(spark, sf):
    path = _folder(spark)
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    d.genome(spark, sf).select(F.concat(F.lit(">"), "chrom", F.lit(" x\n"), F.lower(lines)).alias("value")).write.text(path)
    return io.read_fasta(spark, path, 512)[0].select("chrom", "chunk_idx", "seq")


@query("project_region_dump", sql("SELECT chrom, \"start\", \"end\", region_class FROM regions WHERE regexp_matches(region_class, 'A|R')", "regions"))
def project_region_dump(spark, sf):
    return io.project_region_dump(d.regions(spark, sf), "chrom", "start", "end", "region_class", "A|R")


@query("load_runs", sql("SELECT run, id, pred_length FROM preds", "preds"))
def load_runs(spark, sf):
    path = _folder(spark)
    for run in ("m0", "m1", "m2", "m3"):
        io.write_tsv(d.preds(spark, sf).filter(F.col("run") == run).select("id", "pred_length"), f"{path}/{run}/predictions_test.tsv")
    return io.load_runs(spark, path, filename="predictions_test.tsv/*.csv").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/predictions_test", 1).alias("run"), F.col("id").cast("long").alias("id"), "pred_length")


@query("parquet_roundtrip", sql("SELECT kmer, count(*) AS n, round(sum(ig_score::FLOAT::DOUBLE), 4) AS s FROM kmers GROUP BY kmer", "kmers"))
def parquet_roundtrip(spark, sf):
    rows = io.write_kmers(d.kmers(spark, sf).select("distance", "ig_score", "kmer", "motif_class"), _folder(spark))
    return rounded(rows.groupBy("kmer").agg(F.count("*").alias("n"), F.sum(F.col("ig_score").cast("double")).alias("s")), 4)


@query("concat_chromosomes", sql("SELECT id, chrom FROM loci", "loci"))
def concat_chromosomes(spark, sf):
    paths = [_folder(spark) for _ in range(22)]
    for k, path in enumerate(paths):
        io.write_tsv(d.loci(spark, sf).filter(F.col("chrom") == f"chr{k + 1}").select("id", "chrom"), path)
    return cohort.concat_chromosomes(spark, paths, "id long, chrom string")


@query("position_profile_ci")
def position_profile_ci(spark, sf):
    return rounded(a.position_profile_ci(d.attr(spark, sf)).withColumn("pos", F.col("pos").cast("long")), 5)


@query("write_tsv", sql("SELECT id, numcalled::VARCHAR AS numcalled, round(ref_copy_number, 6) AS ref_copy_number FROM stats", "stats"))
def write_tsv(spark, sf):
    path = _folder(spark)
    io.write_tsv(d.stats(spark, sf).select("id", F.col("numcalled").cast("double").alias("numcalled"), "ref_copy_number"), path, 9)
    return rounded(io.read_table(spark, path, "id long, numcalled string, ref_copy_number double"))


@query("write_run_summary", sql("SELECT count(*) AS n, count(DISTINCT kmer) AS n_kmers FROM kmers", "kmers"))
def write_run_summary(spark, sf):
    path = _folder(spark)
    io.write_run_summary(d.kmers(spark, sf), [F.count("*").alias("n"), F.countDistinct("kmer").alias("n_kmers")], path)
    return spark.read.json(path)


@query("normalize_attr_schema", sql("SELECT id, rev_comp, unnest(['length', 'variation']) AS task, round(list_sum(attr), 4) AS attr, round(pred, 6) AS pred, round(base, 6) AS base FROM attr", "attr"))
def normalize_attr_schema(spark, sf):
    raw = d.attr(spark, sf).select(F.col("id").alias("hipstr_names"), "rev_comp", F.col("attr").alias("attributions"), F.col("pred").alias("predictions_length"), F.col("pred").alias("predictions"), F.col("base").alias("baseline_predictions"))
    total = F.aggregate("attr", F.lit(0.0), lambda s, x: s + x)
    return rounded(io.normalize_attr_schema(raw, ["length", "variation"]).select("id", "rev_comp", "task", F.round(total, 4).alias("attr"), "pred", "base"))
