"""Queries of metrics, models and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import model, stats
from . import derive as d
from .derive import sql
from .registry import query, rounded

_TASKS = ["length", "variation"]
_LONG = ", t AS (SELECT run, motif_len, split, id, rev_comp, 'length' AS task, pred_length AS pred, true_length AS \"true\" FROM preds UNION ALL SELECT run, motif_len, split, id, rev_comp, 'variation', pred_variation, true_variation FROM preds) "


def metric_sql(src: str, group: str) -> str:
    """CTEs r and met: the metrics of src by group and task."""
    return f"""
, r AS (SELECT *, rank() OVER (PARTITION BY {group}, task ORDER BY pred) + (count(*) OVER (PARTITION BY {group}, task, pred) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY {group}, task ORDER BY "true") + (count(*) OVER (PARTITION BY {group}, task, "true") - 1) / 2.0 AS rt FROM {src}),
met AS (SELECT {group}, task, count(*) AS n, avg((pred - "true") * (pred - "true")) AS MSE, avg(abs(pred - "true")) AS MAE,
  avg(abs(pred - "true") / greatest(abs("true"), 2.220446049250313e-16)) AS MAPE,
  1 - avg((pred - "true") * (pred - "true")) / nullif(var_pop("true"), 0) AS R2,
  covar_pop(pred, "true") / nullif(sqrt(var_pop(pred) * var_pop("true")), 0) AS Pearson_r,
  covar_pop(rp, rt) / nullif(sqrt(var_pop(rp) * var_pop(rt)), 0) AS Spearman_r FROM r GROUP BY {group}, task) """


_ROUND = "n, round(MSE, 4) AS MSE, round(MAE, 4) AS MAE, round(ln(1 + MAPE), 6) AS log1p_MAPE, round(R2, 4) AS R2, round(Pearson_r, 4) AS Pearson_r, round(Spearman_r, 4) AS Spearman_r"


def _scores(df, *keys):
    rest = [c for c in m.METRICS if c != "MAPE"]
    return rounded(df.select(*keys, "n", *[F.round(c, 4).alias(c) for c in rest], F.log1p("MAPE").alias("log1p_MAPE")))  # labels of 0 make MAPE huge


@query("target_transform", sql("SELECT id, round(avg(ln(1 + true_length)), 6) AS a, round(avg(asin(sqrt(true_variation))), 6) AS b FROM preds GROUP BY id", "preds"))
def target_transform(spark, sf):
    p = d.preds(spark, sf)
    return rounded(p.groupBy("id").agg(F.avg(m.target_transform(F.col("true_length"), "log1p")).alias("a"), F.avg(m.target_transform(F.col("true_variation"), "arcsine")).alias("b")))


@query("inverse_transform", sql("SELECT id, rev_comp, round(exp(true_variation) - 1, 6) AS a, round(pow(sin(least(true_variation * 3, pi() / 2)), 2), 6) AS b FROM preds", "preds"))
def inverse_transform(spark, sf):
    v = F.col("true_variation")
    return rounded(d.preds(spark, sf).select("id", "rev_comp", m.inverse_transform(v, "log1p").alias("a"), m.inverse_transform(v * 3, "arcsine").alias("b")))


@query("regression_metrics", sql(_LONG + metric_sql("t", "run") + f"SELECT run, task, {_ROUND} FROM met", "preds"))
def regression_metrics(spark, sf):
    return _scores(m.regression_metrics(d.preds(spark, sf), ["run"]), "run", "task")


@query("avg_rank", sql("SELECT id, rev_comp, rank() OVER (ORDER BY pred_variation) + (count(*) OVER (PARTITION BY pred_variation) - 1) / 2.0::DOUBLE AS rank FROM preds", "preds"))
def avg_rank(spark, sf):
    return m.avg_rank(d.preds(spark, sf), "pred_variation").select("id", "rev_comp", F.col("rank").cast("double").alias("rank"))


@query("rc_average", sql("SELECT id, round(avg(pred_length), 9) AS pred_length, min(true_length) AS true_length, count(*) AS n_strands FROM preds GROUP BY id", "preds"))
def rc_average(spark, sf):
    return rounded(m.rc_average(d.preds(spark, sf), ["length"]), 9)


@query("mean_baselines", sql(", tr AS (SELECT * FROM preds WHERE split = 'train' AND motif <> '5-LOW'), g AS (SELECT motif, avg(true_length) AS pg FROM tr GROUP BY motif) SELECT id, motif, true_length AS \"true\", round((SELECT avg(true_length) FROM tr), 4) AS pred_mean, round(pg, 4) AS pred_group_mean FROM preds LEFT JOIN g USING (motif) WHERE split = 'test' AND NOT rev_comp", "preds"))
def mean_baselines(spark, sf):
    p = d.preds(spark, sf).filter("(split = 'train' and motif <> '5-LOW') or (split = 'test' and not rev_comp)")
    return m.mean_baselines(p, "true_length").withColumns({c: F.round(c, 4) for c in ("pred_mean", "pred_group_mean")})


_BY_LEN = sql(_LONG + metric_sql("t", "run, motif_len"), "preds")


def _by_length(spark, sf):
    return m.regression_metrics(d.preds(spark, sf), ["run", "motif_len"])


@query("best_run", _BY_LEN + "SELECT task, motif_len, run, round(MSE, 4) AS MSE FROM met QUALIFY row_number() OVER (PARTITION BY task, motif_len ORDER BY MSE, run) = 1")
def best_run(spark, sf):
    return rounded(m.best_run(_by_length(spark, sf), "MSE", ["task", "motif_len"]).select("task", "motif_len", "run", "MSE"), 4)


@query("leaderboard", sql(_LONG + metric_sql("t", "run") + "SELECT run, task, round(MSE, 4) AS MSE, 'multi_task' AS model_type, row_number() OVER (PARTITION BY task ORDER BY MSE, run) AS place FROM met", "preds"))
def leaderboard(spark, sf):
    got = m.leaderboard(m.regression_metrics(d.preds(spark, sf), ["run"]))
    return rounded(got.select("run", "task", "MSE", "model_type", F.col("place").cast("long").alias("place")), 4)


_SERIES = {"m0": "linear_m0", "m1": "mean_m1"}


@query("metric_by_length", _BY_LEN + "SELECT task, motif_len, " + ", ".join(f"round(max(Spearman_r) FILTER ({c}), 4) AS {n}" for n, c in (("model", "run IN ('m2', 'm3')"), ("linear", "run = 'm0'"), ("mean", "run = 'm1'"))) + " FROM met GROUP BY ALL")
def metric_by_length(spark, sf):
    rows = _by_length(spark, sf).replace(_SERIES, subset="run")
    return rounded(m.metric_by_length(rows, pins={2: "mean_m1"}).select("task", "motif_len", "model", "linear", "mean"), 4)


_FLANKS = ", f AS (SELECT * EXCLUDE (run), (id % 3 + 1) * 1000 AS flank, 'str' || motif_len || '_f' || (id % 3 + 1) * 1000 || '_' || run AS run FROM preds)"


def _flank_runs(spark, sf):
    name = F.concat(F.lit("str"), "motif_len", F.lit("_f"), (F.col("id") % 3 + 1) * 1000, F.lit("_"), "run")
    rows = d.preds(spark, sf).drop("split").withColumn("run", name)
    length, flank = m.flank_of_run(F.col("run"))
    return rows.withColumns({"motif_len": length, "flank": flank})


def _long(*keys):
    return _LONG.replace("SELECT run, motif_len, split, id", f"SELECT {', '.join(keys)}, id")


@query("metric_by_flank", sql(_FLANKS + _long("motif_len", "flank", "run").replace("FROM preds", "FROM f") + metric_sql("t", "motif_len, flank, run") + f"SELECT motif_len, flank, task, run, {_ROUND} FROM met QUALIFY row_number() OVER (PARTITION BY motif_len, flank, task ORDER BY met.Spearman_r DESC NULLS LAST, run) = 1", "preds"))
def metric_by_flank(spark, sf):
    return _scores(m.metric_by_flank(_flank_runs(spark, sf), _TASKS, n_boot=0), "motif_len", "flank", "task", "run")


@query("metric_by_flank_ci")
def metric_by_flank_ci(spark, sf):
    return rounded(m.metric_by_flank(_flank_runs(spark, sf), _TASKS), 4)


_TYPES = {"m0": "single", "m1": "single", "m2": "multi", "m3": "uncertain"}
_TYPE = "CASE run " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " END"


@query("metric_by_model_type", sql(f", f AS (SELECT *, {_TYPE} AS series FROM preds)" + _long("motif_len", "series", "run").replace("FROM preds", "FROM f") + metric_sql("t", "motif_len, series, run") + f"SELECT motif_len, series, run, task, {_ROUND} FROM met", "preds"))
def metric_by_model_type(spark, sf):
    return _scores(m.metric_by_model_type(d.preds(spark, sf), _TASKS, _TYPES, per=["motif_len"], n_boot=0), "motif_len", "series", "run", "task")


@query("metric_by_model_type_ci")
def metric_by_model_type_ci(spark, sf):
    return rounded(m.metric_by_model_type(d.preds(spark, sf), _TASKS, _TYPES, per=["motif_len"]), 4)


@query("target_variance", sql("SELECT 'true_length' AS target, round(var_pop(ln(1 + true_length)), 6) AS variance FROM preds WHERE split = 'train' UNION ALL SELECT 'true_variation', round(var_pop(asin(sqrt(true_variation))), 6) FROM preds WHERE split = 'train'", "preds"))
def target_variance(spark, sf):
    return rounded(m.target_variance(d.preds(spark, sf).filter("split = 'train'"), {"true_length": "log1p", "true_variation": "arcsine"}))


@query("fixed_variance_score", sql("SELECT round(avg(pow(ln(1 + pred_length) - ln(1 + true_length), 2)) / var_pop(ln(1 + true_length)) + avg(pow(pred_variation - true_variation, 2)) / var_pop(true_variation), 5) AS score FROM preds", "preds"))
def fixed_variance_score(spark, sf):
    p = d.preds(spark, sf)
    kinds = {"length": "log1p", "variation": "identity"}
    v = m.target_variance(p, {f"true_{k}": n for k, n in kinds.items()}).withColumn("target", F.replace("target", F.lit("true_"), F.lit("")))
    return rounded(m.fixed_variance_score(p, v, kinds), 5)


@query("bootstrap_metrics")
def bootstrap_metrics(spark, sf):
    return rounded(m.bootstrap_metrics(d.preds(spark, sf), ["length", "variation"], per=["run", "motif_len", "rev_comp"]), 4)


@query("standardize", sql(", tr AS (SELECT avg(true_length) AS a, stddev_pop(true_length) AS s FROM preds WHERE split = 'train') SELECT id, rev_comp, round((true_length - a) / s, 6) AS true_length FROM preds, tr", "preds"))
def standardize(spark, sf):
    return rounded(model.standardize(d.preds(spark, sf), ["true_length"]).select("id", "rev_comp", "true_length"))


_FEATURES = ["true_variation", "pred_variation"]


_RIDGE = """, a AS (SELECT avg(true_variation) AS m1, stddev_pop(true_variation) AS s1, avg(pred_variation) AS m2, stddev_pop(pred_variation) AS s2 FROM preds WHERE split = 'train'),
z AS (SELECT split, (true_variation - m1) / s1 AS x1, (pred_variation - m2) / s2 AS x2, ln(1 + true_length) AS y FROM preds, a),
g AS (SELECT avg(x1) AS c1, avg(x2) AS c2, avg(y) AS cy, covar_pop(x1, x1) * count(*) AS q11, covar_pop(x1, x2) * count(*) AS q12, covar_pop(x2, x2) * count(*) AS q22, covar_pop(x1, y) * count(*) AS p1, covar_pop(x2, y) * count(*) AS p2 FROM z WHERE split = 'train'),
w AS (SELECT alpha, ((q22 + alpha) * p1 - q12 * p2) / ((q11 + alpha) * (q22 + alpha) - q12 * q12) AS w1, ((q11 + alpha) * p2 - q12 * p1) / ((q11 + alpha) * (q22 + alpha) - q12 * q12) AS w2, c1, c2, cy FROM g, (SELECT unnest([{alphas}]::DOUBLE[]) AS alpha)),
v AS (SELECT alpha, w1, w2, cy - w1 * c1 - w2 * c2 AS b FROM w),
e AS (SELECT alpha, any_value(w1) AS w1, any_value(w2) AS w2, any_value(b) AS b, avg(pow(y - b - w1 * x1 - w2 * x2, 2)) AS mse FROM v, z WHERE split = 'val' GROUP BY alpha),
r AS (SELECT *, row_number() OVER (ORDER BY mse, alpha) = 1 AS chosen FROM e) """


@query("ridge_alpha_search", sql(_RIDGE.format(alphas="0.1, 1, 10, 1000") + "SELECT alpha, round(mse, 6) AS val_mse, chosen FROM r", "preds"))
def ridge_alpha_search(spark, sf):
    return rounded(model.ridge_alpha_search(model.standardize(d.preds(spark, sf), _FEATURES), _FEATURES, "true_length", [0.1, 1.0, 10.0, 1000.0], "log1p")[1])


@query("ridge_coefficients", sql(_RIDGE.format(alphas="0.1, 1, 10") + "SELECT unnest(['true_variation', 'pred_variation', 'intercept']) AS feature_name, round(unnest([w1, w2, b]), 6) AS coef FROM r WHERE chosen", "preds"))
def ridge_coefficients(spark, sf):
    return rounded(model.ridge_alpha_search(model.standardize(d.preds(spark, sf), _FEATURES), _FEATURES, "true_length", [0.1, 1.0, 10.0], "log1p")[0])


@query("predict_native", sql("SELECT id, rev_comp, round(exp(0.5 + 2.0 * true_variation - 1.0 * pred_variation) - 1, 6) AS pred FROM preds", "preds"))
def predict_native(spark, sf):
    coefs = {"intercept": 0.5, "true_variation": 2.0, "pred_variation": -1.0}
    return rounded(model.predict_native(d.preds(spark, sf), _FEATURES, coefs, "log1p").select("id", "rev_comp", "pred"))


@query("batch_score", sql("SELECT id, rev_comp, round(0.5 + 2.0 * true_variation - 1.0 * pred_variation, 6) AS pred FROM preds", "preds"))
def batch_score(spark, sf):
    def scorer(f):
        out = f[["id", "rev_comp"]].copy()
        out["pred"] = 0.5 + 2.0 * f["true_variation"] - f["pred_variation"]
        return out

    return rounded(model.batch_score(d.preds(spark, sf), scorer, "pred double", ["id", "rev_comp"]))


_COEF = """, n AS (SELECT p_partkey, p_partkey % 3 AS b, (p_retailprice - 1500) / 1000 AS coef, CASE p_partkey % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 4 THEN 'flank' WHEN 5 THEN 'flank' END AS side, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 5 THEN 3 END AS k, CASE p_partkey % 6 WHEN 0 THEN 'ACG' WHEN 1 THEN 'ACGT' WHEN 2 THEN 'AC/GT' WHEN 4 THEN 'gc' WHEN 5 THEN 'AAA' END AS word, p_partkey % 6 <> 3 AS known FROM part),
o AS (SELECT *, CASE WHEN p_partkey % 6 = 5 THEN 0 WHEN side IS NOT NULL THEN b END AS bin FROM n),
c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'motif_AC/GT' WHEN 3 THEN 'other' WHEN 4 THEN 'flank_bin' || b || '_gc' WHEN 5 THEN 'flank_3mer_AAA' ELSE side || '_bin' || b || '_' || k || 'mer_' || word END AS feature_name, coef, known, side, bin::INT AS bin, [0, 100, 300][bin + 1] AS bp_start, [100, 300, 1000][bin + 1] AS bp_end, k, word, CASE WHEN NOT known THEN NULL WHEN side IS NULL THEN 'motif' ELSE side || '_' || bin END AS category FROM o) """


def _coefs(spark, sf):
    k = F.col("p_partkey")
    numbered = lambda side, rest: F.concat(F.lit(f"{side}_bin"), k % 3, F.lit(rest))
    name = (
        F.when(k % 6 == 0, numbered("left", "_3mer_ACG")).when(k % 6 == 1, numbered("right", "_4mer_ACGT")).when(k % 6 == 2, "motif_AC/GT")
        .when(k % 6 == 4, numbered("flank", "_gc")).when(k % 6 == 5, "flank_3mer_AAA").otherwise("other")
    )
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("feature_name"), ((F.col("p_retailprice") - 1500) / 1000).alias("coef"))
    return model.parse_feature_name(rows, [(0, 100), (100, 300), (300, 1000)])


@query("parse_feature_name", "WITH x AS (SELECT 1)" + _COEF + "SELECT p_partkey, known, side, bin, bp_start, bp_end, k, word, category FROM c")
def parse_feature_name(spark, sf):
    return _coefs(spark, sf).select("p_partkey", "known", "side", "bin", "bp_start", "bp_end", "k", "word", "category")


@query("rank_coefficients", "WITH x AS (SELECT 1)" + _COEF + "SELECT feature_name, round(coef, 6) AS coef, round(abs(coef), 6) AS abs_coef FROM c ORDER BY abs(coef) DESC, feature_name LIMIT 5")
def rank_coefficients(spark, sf):
    return rounded(model.rank_coefficients(_coefs(spark, sf), 5).select("feature_name", "coef", "abs_coef"))


@query("category_importance", "WITH x AS (SELECT 1)" + _COEF + "SELECT k, round(avg(abs(coef)), 6) AS mean_abs, round(sum(abs(coef)), 4) AS sum_abs, count(*) AS n FROM c GROUP BY k")
def category_importance(spark, sf):
    return rounded(model.category_importance(_coefs(spark, sf), "k").withColumn("sum_abs", F.round("sum_abs", 4)))


@query("coef_spatial_profile", "WITH x AS (SELECT 1)" + _COEF + "SELECT side, bin, CASE side WHEN 'left' THEN -1 ELSE 1 END * [50.0, 200.0, 650.0][bin + 1]::DOUBLE AS distance, round(avg(abs(coef)), 6) AS mean_abs FROM c WHERE side IN ('left', 'right') GROUP BY ALL")
def coef_spatial_profile(spark, sf):
    return rounded(model.coef_spatial_profile(_coefs(spark, sf)))


@query("correlation_pvalue")
def correlation_pvalue(spark, sf):
    return rounded(m.regression_metrics(d.preds(spark, sf), ["run"], pvalues=True).select("run", "task", "Pearson_p", "Spearman_p"))


@query("histogram_proportion", "WITH g AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT o_orderpriority, least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin FROM orders, g), c AS (SELECT o_orderpriority, bin, count(*) AS n FROM b GROUP BY ALL) SELECT o_orderpriority, bin, n, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM c")
def histogram_proportion(spark, sf):
    return rounded(stats.histogram_proportion(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", "o_orderpriority"))


@query("quantile_summary", "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority")
def quantile_summary(spark, sf):
    return rounded(stats.quantile_summary(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", per=["o_orderpriority"]), 4)


@query("label_correlations", sql(", r AS (SELECT *, rank() OVER (PARTITION BY motif_len ORDER BY pred_length) + (count(*) OVER (PARTITION BY motif_len, pred_length) - 1) / 2.0 AS a, rank() OVER (PARTITION BY motif_len ORDER BY pred_variation) + (count(*) OVER (PARTITION BY motif_len, pred_variation) - 1) / 2.0 AS b FROM preds) SELECT motif_len, count(*) AS n, round(corr(pred_length, pred_variation), 5) AS pearson, round(corr(a, b), 5) AS spearman FROM r GROUP BY motif_len", "preds"))
def label_correlations(spark, sf):
    return rounded(stats.label_correlations(d.preds(spark, sf), "pred_length", "pred_variation", "motif_len"), 5)


@query("density_2d", sql(", s AS (SELECT least(min(true_length), min(pred_length)) AS a, greatest(max(true_length), max(pred_length)) AS b FROM preds), q AS (SELECT a - 0.05 * (b - a) AS lo, b + 0.05 * (b - a) AS hi FROM s) SELECT least(floor((true_length - lo) / (hi - lo) * 50), 49)::BIGINT AS x_bin, least(floor((pred_length - lo) / (hi - lo) * 50), 49)::BIGINT AS y_bin, count(*) AS n FROM preds, q GROUP BY ALL", "preds"))
def density_2d(spark, sf):
    return stats.density_2d(d.preds(spark, sf), "true_length", "pred_length")


@query("residuals", sql(", r AS (SELECT pred_length - true_length AS r FROM preds) SELECT count(*) AS n, round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS std, round(min(r), 4) AS lo, round(quantile_cont(r, 0.5), 4) AS median, round(max(r), 4) AS hi FROM r", "preds"))
def residuals(spark, sf):
    return rounded(stats.residuals(d.preds(spark, sf), "pred_length", "true_length"), 4)


@query("box_stats", "WITH q AS (SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY p_brand) SELECT p_brand, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(p_retailprice), 4) AS whisker_lo, round(max(p_retailprice), 4) AS whisker_hi FROM q JOIN part USING (p_brand) WHERE p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def box_stats(spark, sf):
    return rounded(stats.box_stats(spark.read.parquet(f"{sf}/part.parquet"), "p_retailprice", "p_brand"), 4)


_KW = "WITH r AS (SELECT {c} AS c, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS rk FROM {t}), g AS (SELECT c, sum(rk) AS s, count(*) AS m FROM r GROUP BY c), t AS (SELECT sum(x * x * x - x)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS x FROM r GROUP BY v)), a AS (SELECT sum(s * s / m) AS s, sum(m)::DOUBLE AS n, count(*) AS k FROM g), h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS H, k, n FROM a, t) SELECT round(H, 4) AS H, k, n::BIGINT AS n, round(H / (n - 1), 6) AS epsilon_sq, round((H - k + 1) / (n - k), 6) AS eta_sq{p} FROM h"


@query("kruskal_wallis", _KW.format(c="o_orderpriority", v="o_totalprice", t="orders", p=", round(exp(-H / 2) * (1 + H / 2), 6) AS p"))  # five groups: the tail for 4 degrees
def kruskal_wallis(spark, sf):
    got = stats.kruskal_wallis(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", "o_orderpriority")
    return rounded(got.withColumn("H", F.round("H", 4)))


_TABLE = " UNION ALL ".join(f"SELECT '{v}' AS label, '{c}' AS category, * FROM ({_KW.format(c=c, v=v, t='part', p='')})" for v in ("p_retailprice", "p_size") for c in ("p_brand", "p_type"))


@query("effect_size_table", _TABLE)
def effect_size_table(spark, sf):
    got = stats.effect_size_table(spark.read.parquet(f"{sf}/part.parquet"), ["p_retailprice", "p_size"], ["p_brand", "p_type"])
    return rounded(got.drop("p")).withColumn("H", F.round("H", 4))  # SQL has no tail for any degrees


@query("pca_projection")
def pca_projection(spark, sf):
    return rounded(stats.pca_projection(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding", "vec_id"), 4)
