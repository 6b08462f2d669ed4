"""Standardisation, ridge search, scoring, and the reading of linear coefficients."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import inverse_transform
from .ridge import fit_ridge


def standardize(df: DataFrame, features: Sequence[str], fit_filter: str = "split = 'train'") -> DataFrame:
    """Features minus the train mean over the train population deviation (0 counts as 1). For thousands of features, `fit_ridge` scales vectors itself."""
    stats = df.filter(fit_filter).agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in features}).select(*df.columns)  # one row joins


def ridge_alpha_search(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float], transform: str = "identity"):
    """(coefficients, search table) of `fit_ridge` on feature columns as they are: fitted on train for each alpha, chosen by the least validation MSE."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    fit = fit_ridge(df.select("split", F.col(label).alias("_label"), values.alias("values")), len(features), {"_label": transform}, alphas, slots=None, scale=False, features=features)
    spark = df.sparkSession
    return fit.coef_frame(spark).drop("target"), fit.search_frame(spark).drop("target")


def linear_scorer(features: Sequence[str], coefs: dict[str, float], transform: str = "identity") -> Column:
    """Prediction in native units as one expression over feature columns."""
    total = F.lit(float(coefs.get("intercept", 0.0)))
    for f in features:
        total = total + F.col(f) * F.lit(float(coefs[f]))
    return inverse_transform(total, transform)


def predict_native(df: DataFrame, features: Sequence[str], coefs: dict[str, float], transform: str = "identity", out: str = "pred") -> DataFrame:
    return df.withColumn(out, linear_scorer(features, coefs, transform))


_LOADED: dict[str, object] = {}


def loaded(token: str, load: Callable):
    """What `load()` returns, kept in the Python worker from task to task; another token takes its place."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = load()
    return _LOADED[token]


def batch_score(df: DataFrame, scorer: Callable, out_schema: str, keep: Sequence[str]) -> DataFrame:
    """`scorer(pandas frame) -> pandas frame` over Arrow batches; `keep` and what it adds come out."""
    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)
    return df.mapInPandas(lambda frames: (scorer(f) for f in frames), f"{kept}, {out_schema}")


FEATURE_NAME = r"^(?:(left|right|flank)(?:_bin(\d+))?_(?:(\d+)mer_([ACGT]+)|(gc))|motif_(.+))$"


def parse_feature_name(coefs: DataFrame, edges: Sequence[tuple[int, int]], name: str = "feature_name") -> DataFrame:
    """Side, bin, distance range, k, k-mer and category of each feature; `known` is false where the name does not fit."""
    part = lambda i: F.regexp_extract(name, FEATURE_NAME, i)
    bin_ = F.expr(f"try_cast(nullif(regexp_extract({name}, r'{FEATURE_NAME}', 2), '') as int)")
    at = F.coalesce(bin_, F.lit(0))
    lo, hi = F.array(*[F.lit(a) for a, _ in edges]), F.array(*[F.lit(b) for _, b in edges])
    known = F.col(name).rlike(FEATURE_NAME)
    flank = known & (part(6) == "")
    side = F.when(part(1) != "", part(1))
    category = F.when(~known, None).when(part(6) != "", "motif").otherwise(F.concat(side, F.lit("_"), at))
    return coefs.select(
        "*", known.alias("known"), side.alias("side"), F.when(flank, at).alias("bin"), F.when(flank, F.get(lo, at)).alias("bp_start"), F.when(flank, F.get(hi, at)).alias("bp_end"),
        F.expr(f"try_cast(nullif(regexp_extract({name}, r'{FEATURE_NAME}', 3), '') as int)").alias("k"), F.nullif(F.concat(part(4), part(5), part(6)), F.lit("")).alias("word"), category.alias("category"),
    )


def rank_coefficients(coefs: DataFrame, n: int = 30, per: Sequence[str] = ()) -> DataFrame:
    rows = coefs.withColumn("abs_coef", F.abs("coef"))
    if not per:
        return rows.orderBy(F.desc("abs_coef"), "feature_name").limit(n)
    w = Window.partitionBy(*per).orderBy(F.desc("abs_coef"), "feature_name")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def category_importance(ranked: DataFrame, group_col: str) -> DataFrame:
    return ranked.groupBy(group_col).agg(F.avg(F.abs("coef")).alias("mean_abs"), F.sum(F.abs("coef")).alias("sum_abs"), F.count("*").alias("n"))


def coef_spatial_profile(ranked: DataFrame) -> DataFrame:
    """Mean |coef| by side and bin with the bin's signed middle; empty with one bin only."""
    rows = ranked.filter("side in ('left', 'right') and bin is not null")
    bins = rows.agg(F.countDistinct("bin").alias("n_bins"))
    middle = (F.col("bp_start") + F.col("bp_end")) / 2
    out = rows.groupBy("side", "bin", F.when(F.col("side") == "left", -middle).otherwise(middle).alias("distance")).agg(F.avg(F.abs("coef")).alias("mean_abs"))
    return out.crossJoin(F.broadcast(bins)).filter("n_bins > 1").drop("n_bins")  # one row joins
