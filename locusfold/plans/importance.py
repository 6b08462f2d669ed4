"""Queries of region permutation importance, reach and profile clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importance as i
from ..operators import ward
from ..operators import metrics
from . import derive as d
from .derive import sql
from .evaluation import metric_sql
from .registry import query, rounded

_REGIONS = ", rg AS (SELECT region_id, CASE WHEN region_id % 2 = 0 THEN 'left' ELSE 'right' END AS flank, region_id // 2 AS region_idx, region_id // 2 * 10 AS distance_start, CASE WHEN region_id < 2 THEN 10 ELSE 15 END AS distance_end FROM (SELECT unnest(range(0, 4)) AS region_id)) "


def _regions(spark):
    return i.flank_regions(i.layout(spark, 15, 2, 4, 3), 10)


@query("flank_regions", "WITH lay AS (SELECT p_partkey, p_size * 3 AS n_flank, p_partkey % 5 AS n_prefix, p_partkey % 9 AS n_str, p_partkey % 4 AS n_gap FROM part), rl AS (SELECT *, unnest(range(0, (n_flank + 24) // 25)) AS region_idx FROM lay), b AS (SELECT *, region_idx * 25 AS lo, least(region_idx * 25 + 25, n_flank) AS hi, n_prefix + n_flank + 2 * n_str + n_gap AS r FROM rl) SELECT p_partkey, 'left' AS flank, region_idx, 2 * region_idx AS region_id, n_prefix + n_flank - hi AS token_start, n_prefix + n_flank - lo AS token_end, lo AS distance_start, hi AS distance_end FROM b WHERE hi <= 120 UNION ALL SELECT p_partkey, 'right', region_idx, 2 * region_idx + 1, r + lo, r + hi, lo, hi FROM b WHERE hi <= 120")
def flank_regions(spark, sf):
    k = F.col("p_partkey")
    layouts = spark.read.parquet(f"{sf}/part.parquet").select(k, (F.col("p_size") * 3).alias("n_flank"), (k % 5).alias("n_prefix"), (k % 9).alias("n_str"), (k % 4).alias("n_gap"))
    return i.flank_regions(layouts, 25, 120).drop("n_flank", "n_prefix", "n_str", "n_gap")


_SHUFFLED = "array_to_string(list_transform(list_sort(list_transform(range(1, 11), lambda k: md5('42|' || id || '|' || rev_comp::VARCHAR || '|' || k) || substr(sequence, 20 + k, 1))), lambda x: right(x, 1)), '')"


@query("shuffle_region", sql(f"SELECT id, rev_comp, left(sequence, 20) || {_SHUFFLED} || substr(sequence, 31) AS s FROM attr", "attr"))
def shuffle_region(spark, sf):
    rows = d.attr(spark, sf)
    lo, hi = F.lit(20).cast("long"), F.lit(30).cast("long")
    return rows.select("id", "rev_comp", i.shuffle_region(F.col("sequence"), lo, hi, 42, "id", "rev_comp").alias("s"))


_SCORE = "(strpos({0}, 'AC') + strpos({0}, 'GT') * 2 + length(replace({0}, 'CG', '')))::DOUBLE"
_TOKENS = "[12, 40, 0, 52][region_id + 1]"


_PERTURBED = f", p AS (SELECT id, rev_comp, sequence, region_id, perm, {_TOKENS} AS tk FROM attr, (SELECT unnest(range(0, 4)) AS region_id), (SELECT unnest(range(0, 3)) AS perm)), s AS (SELECT *, left(sequence, tk) || array_to_string(list_transform(list_sort(list_transform(range(1, 13), lambda k: md5('42|' || id || '|' || rev_comp::VARCHAR || '|' || region_id || '|' || perm || '|' || k) || substr(sequence, tk + k, 1))), lambda x: right(x, 1)), '') || substr(sequence, tk + 13) AS mixed FROM p)"


@query("perturbed_predictions", sql(_PERTURBED + f" SELECT id, rev_comp, region_id, perm, {_SCORE.format('sequence')} AS baseline, {_SCORE.format('mixed')} AS permuted FROM s", "attr"))
def perturbed_predictions(spark, sf):
    rows = d.attr(spark, sf).select("id", "rev_comp", F.col("sequence").alias("input"))
    score = lambda s: (F.instr(s, "AC") + F.instr(s, "GT") * 2 + F.length(F.replace(s, F.lit("CG"), F.lit("")))).cast("double")
    return i.perturbed_predictions(rows, i.flank_regions(i.layout(spark, 24, 0, 8, 0), 12), 3, score)


@query("delta_summary", sql("SELECT task, round(avg(abs(permuted - baseline)), 5) AS mean_abs_delta, round(max(abs(permuted - baseline)), 5) AS max_abs_delta, count(*) AS n FROM perturbed GROUP BY task", "perturbed"))
def delta_summary(spark, sf):
    return rounded(i.delta_summary(d.perturbed(spark, sf)), 5)


_PCT = ", e AS (SELECT region_id, id, rev_comp, abs(avg(100 * (permuted - baseline) / nullif(baseline, 0))) AS p FROM perturbed GROUP BY ALL) "


@query("local_effect", sql(_PCT + "SELECT region_id, round(avg(p), 5) AS local_mean, round(stddev_samp(p), 5) AS local_std, count(p) AS n, count(*) FILTER (p IS NULL) AS n_zero FROM e GROUP BY region_id", "perturbed"))
def local_effect(spark, sf):
    return rounded(i.local_effect(d.perturbed(spark, sf)), 5)


@query("local_effect_ci")
def local_effect_ci(spark, sf):
    return rounded(i.local_effect_ci(d.perturbed(spark, sf)), 5)


def _truth(spark, sf):
    return d.perturbed(spark, sf).select("id", "rev_comp", (F.col("baseline") * 1.1).alias("true")).distinct()


_D = ", ".join(f'round({a}, 5) AS "d_{n}"' for n, a in ((n, f"avg({'' if n in metrics.ERRORS else '-'}(m.{n} - b.{n}))") for n in metrics.METRICS))
_GLOBAL = (
    ", x AS (SELECT region_id, perm, baseline * 1.1 AS \"true\", permuted AS pred, 't' AS task FROM perturbed UNION ALL SELECT -1, 0, baseline * 1.1, baseline, 't' FROM perturbed WHERE region_id = 0 AND perm = 0)"
    + metric_sql("x", "region_id, perm") + f", g AS (SELECT m.region_id, {_D} FROM met m, met b WHERE m.region_id >= 0 AND b.region_id = -1 GROUP BY m.region_id) "
)


@query("global_effect", sql(_GLOBAL + "SELECT * FROM g", "perturbed"))
def global_effect(spark, sf):
    return rounded(i.global_effect(d.perturbed(spark, sf), _truth(spark, sf)), 5)


def _table(spark, sf):
    p = d.perturbed(spark, sf)
    return i.region_table(_regions(spark), i.local_effect(p), i.global_effect(p, _truth(spark, sf)))


_ENDS = "CASE flank WHEN 'left' THEN 17 - distance_end ELSE 28 + distance_start END AS token_start, CASE flank WHEN 'left' THEN 17 - distance_start ELSE 28 + distance_end END AS token_end"


_RT = _PCT + _GLOBAL + _REGIONS + f", l AS (SELECT region_id, round(avg(p), 5) AS local_mean, round(stddev_samp(p), 5) AS local_std, count(p) AS n, count(*) FILTER (p IS NULL) AS n_zero FROM e GROUP BY region_id), rt AS (SELECT region_id, flank, region_idx, distance_start, distance_end, {_ENDS}, (distance_start + distance_end) / 2.0 AS midpoint, l.* EXCLUDE (region_id), g.* EXCLUDE (region_id) FROM rg LEFT JOIN l USING (region_id) LEFT JOIN g USING (region_id)) "


@query("region_table", sql(_RT + "SELECT * FROM rt", "perturbed"))
def region_table(spark, sf):
    return rounded(_table(spark, sf), 5)


@query("top_regions", sql(_RT + "SELECT 'local_mean' AS ranking, row_number() OVER (ORDER BY local_mean DESC, region_id) AS place, * FROM rt WHERE local_mean IS NOT NULL UNION ALL SELECT 'd_Spearman_r', row_number() OVER (ORDER BY \"d_Spearman_r\" DESC, region_id), * FROM rt WHERE \"d_Spearman_r\" IS NOT NULL", "perturbed"))
def top_regions(spark, sf):
    return i.top_regions(rounded(_table(spark, sf), 5)).withColumn("place", F.col("place").cast("long"))


@query("flank_summary", sql(_RT + ", v AS (SELECT flank, unnest(['local_mean', 'd_Spearman_r']) AS value, unnest([local_mean, \"d_Spearman_r\"]) AS x, region_idx, distance_start, distance_end FROM rt) SELECT flank, value, count(*) AS n_regions, round(max(x), 5) AS max, round(avg(x) + 1e-7, 4) AS mean, round(min(x), 5) AS min, arg_max(region_idx, (x, -region_idx)) AS region_idx, arg_max(distance_start, (x, -region_idx)) AS distance_start, arg_max(distance_end, (x, -region_idx)) AS distance_end FROM v GROUP BY flank, value", "perturbed"))
def flank_summary(spark, sf):
    return i.flank_summary(rounded(_table(spark, sf), 5)).withColumn("mean", F.round(F.col("mean") + 1e-7, 4))


def _load():
    """A stand-in for a model's loading: the scores of `perturbed_predictions` from batches, and their halves."""
    def scorer(f):
        x = f["input"]
        score = (x.str.find("AC") + 1 + (x.str.find("GT") + 1) * 2 + x.str.replace("CG", "").str.len()).astype(float)
        return f[["id"]].assign(length=score, variation=score / 2)

    return scorer


@query("perturbed_scores", sql(_PERTURBED + f", b AS (SELECT id, rev_comp, region_id, perm, {_SCORE.format('sequence')} AS x, {_SCORE.format('mixed')} AS y FROM s) SELECT id, rev_comp, 'length' AS task, region_id, perm::INT AS perm, x AS baseline, y AS permuted FROM b UNION ALL SELECT id, rev_comp, 'variation', region_id, perm::INT, x / 2, y / 2 FROM b", "attr"))
def perturbed_scores(spark, sf):
    rows = d.attr(spark, sf).select("id", "rev_comp", F.col("sequence").alias("input"))
    return i.perturbed_scores(rows, i.flank_regions(i.layout(spark, 24, 0, 8, 0), 12), 3, _load, ["length", "variation"])



@query("left_right_compare", sql(_PCT + ", l AS (SELECT region_id, avg(p) AS v FROM e GROUP BY region_id) SELECT a.region_id // 2 AS region_idx, round(a.v, 5) AS left_value, round(b.v, 5) AS right_value, round(a.v - b.v, 5) AS difference FROM l a JOIN l b ON a.region_id % 2 = 0 AND b.region_id = a.region_id + 1", "perturbed"))
def left_right_compare(spark, sf):
    return rounded(i.left_right_compare(_table(spark, sf)), 5)


_GENOMIC = _PCT + _REGIONS + ", st AS (SELECT id FROM perturbed GROUP BY id HAVING count(DISTINCT rev_comp) = 2), gp AS (SELECT id, CASE WHEN (flank = 'left') <> rev_comp THEN 'up' ELSE 'down' END AS side, region_idx, (distance_start + distance_end) / 2.0 AS midpoint, avg(p) AS value FROM e JOIN rg USING (region_id) SEMI JOIN st USING (id) GROUP BY ALL) "


def _genomic(spark, sf):
    return i.genomic_profile(d.perturbed(spark, sf), _regions(spark))


@query("genomic_profile", sql(_GENOMIC + "SELECT id, side, region_idx, midpoint, round(value, 5) AS value FROM gp", "perturbed"))
def genomic_profile(spark, sf):
    return rounded(_genomic(spark, sf)[0], 5)


@query("profile_mean", sql(_GENOMIC + "SELECT side, region_idx, midpoint, round(avg(value), 5) AS mean, count(value) AS n FROM gp GROUP BY ALL", "perturbed"))
def profile_mean(spark, sf):
    return rounded(i.profile_mean(_genomic(spark, sf)[0]), 5)


@query("profile_mean_ci")
def profile_mean_ci(spark, sf):
    return rounded(i.profile_mean_ci(_genomic(spark, sf)[0]).select("side", "region_idx", "lo", "hi"), 5)


@query("profile_overlay", sql(_GENOMIC + ", mm AS (SELECT side, region_idx, avg(value) AS mean FROM gp GROUP BY ALL) SELECT side, region_idx, round(mean / max(mean) OVER (PARTITION BY side), 5) AS scaled FROM mm", "perturbed"))
def profile_overlay(spark, sf):
    return rounded(i.profile_overlay(i.profile_mean(_genomic(spark, sf)[0])).select("side", "region_idx", "scaled"), 5)


_REACH = ", w AS (SELECT id, midpoint, greatest(value, 0) AS w, sum(greatest(value, 0)) OVER (PARTITION BY id) AS t, sum(greatest(value, 0)) OVER (PARTITION BY id ORDER BY midpoint) AS c FROM profiles) "


@query("reach_metrics", sql(_REACH + "SELECT id, round(coalesce(sum(w * midpoint) / nullif(max(t), 0), 0), 5) AS center_of_mass, round(coalesce(sum(CASE WHEN midpoint > 1000 THEN w ELSE 0 END) / nullif(max(t), 0), 0), 5) AS frac_beyond, CASE WHEN max(t) > 0 THEN coalesce(min(CASE WHEN c / t >= 0.9 THEN midpoint END), max(midpoint)) ELSE 0 END AS reach_distance FROM w GROUP BY id", "profiles"))
def reach_metrics(spark, sf):
    return rounded(i.reach_metrics(d.profiles(spark, sf)), 5)


def _units(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p"))
    return rows.withColumn("unit", i.unit_area(F.col("p"))).drop("p")


@query("unit_area", sql(_REACH + "SELECT id, midpoint, round(w / t, 6) AS share FROM w WHERE t > 0", "profiles"))
def unit_area(spark, sf):
    return rounded(_units(spark, sf).select("id", F.posexplode("unit").alias("k", "share")).select("id", (F.col("k") * 100 + 50).cast("double").alias("midpoint"), "share"))


@query("profile_kmeans")
def profile_kmeans(spark, sf):
    return i.profile_kmeans(_units(spark, sf)).select("id", "cluster")


@query("silhouette_sweep")
def silhouette_sweep(spark, sf):
    return i.silhouette_sweep(_units(spark, sf), (2, 3, 4))


@query("hierarchical_profiles")
def hierarchical_profiles(spark, sf):
    return ward.hierarchical_profiles(_units(spark, sf))[0].select("id", "cluster")


@query("hierarchy_heights")
def hierarchy_heights(spark, sf):
    return rounded(ward.hierarchical_profiles(_units(spark, sf))[1])


def _labels(spark, sf):
    return _units(spark, sf).withColumn("cluster", (F.col("id") % 3).cast("int"))


@query("long_range_cluster", sql(_REACH + ", r AS (SELECT id, id % 3 AS cluster, sum(w * midpoint) / max(t) AS cm FROM w GROUP BY id), b AS (SELECT cluster, avg(cm) AS m, count(*) AS n FROM r GROUP BY cluster ORDER BY m DESC LIMIT 1) SELECT id, r.cluster::INT AS cluster, n AS cluster_size, round(cm, 5) AS center_of_mass FROM r JOIN b ON r.cluster = b.cluster", "profiles"))
def long_range_cluster(spark, sf):
    return rounded(i.long_range_cluster(_labels(spark, sf), i.reach_metrics(d.profiles(spark, sf))), 5)


@query("cluster_examples", sql(_REACH + ", u AS (SELECT id, id % 3 AS cluster, midpoint, w / t AS x FROM w), c AS (SELECT cluster, midpoint, avg(x) AS m FROM u GROUP BY ALL), q AS (SELECT u.id, u.cluster, sqrt(sum(pow(x - m, 2))) AS dist FROM u JOIN c USING (cluster, midpoint) GROUP BY ALL) SELECT cluster::INT AS cluster, id, round(dist, 6) AS distance FROM q QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY dist, id) <= 5", "profiles"))
def cluster_examples(spark, sf):
    return rounded(i.cluster_examples(_labels(spark, sf)).select("cluster", "id", "distance"))
