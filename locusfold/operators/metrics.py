"""Regression metrics, ranks, bootstraps and leaderboards."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import avg_rank as avg_rank, avg_ranks, join_same, present
from .resampling import drawn_size, in_pieces, pieces, times, whole_vectors, with_interval
from .staging import stored
from .stats import correlation, correlation_pvalue

EPSILON = 2.220446049250313e-16
ERRORS = ("MSE", "MAE", "MAPE")
METRICS = ("MSE", "MAE", "MAPE", "R2", "Pearson_r", "Spearman_r")


def target_transform(y: Column, name: str) -> Column:
    if name == "log1p":
        return F.log1p(y)
    if name == "arcsine":
        return F.asin(F.sqrt(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))))
    return y


def inverse_transform(p: Column, name: str) -> Column:
    if name == "log1p":
        return F.expm1(p)
    if name == "arcsine":
        s = F.sin(F.least(F.greatest(p, F.lit(0.0)), F.lit(math.pi / 2)))
        return s * s
    return p


def detect_tasks(df: DataFrame) -> list[str]:
    """Tasks that have both a predicted and a true column."""
    return [c[5:] for c in df.columns if c.startswith("pred_") and f"true_{c[5:]}" in df.columns]


def long_predictions(df: DataFrame, tasks: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, task, pred, true) with one row per task."""
    each = [F.struct(F.lit(t).alias("task"), F.col(f"pred_{t}").cast("double").alias("pred"), F.col(f"true_{t}").cast("double").alias("true")) for t in tasks]
    return df.select(*keep, F.explode(F.array(*each)).alias("s")).select(*keep, "s.*")


def regression_metrics(df: DataFrame, group: Sequence[str], tasks: Sequence[str] | None = None, pvalues: bool = False) -> DataFrame:
    """One row per group and task: n, MSE, MAE, MAPE, R2, Pearson_r, Spearman_r[, Pearson_p, Spearman_p].

    Rows whose prediction or label is missing (null or NaN) are left out. `df` is read once, by a job of this call.
    """
    tasks = list(tasks or detect_tasks(df))
    long = stored(long_predictions(df, tasks, group).filter(present("pred", "true")))
    by = [*group, "task"]
    ranked = avg_ranks(long, {"pred": "rank_pred", "true": "rank_true"}, by)
    err = F.col("pred") - F.col("true")
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(err * err).alias("MSE"), F.avg(F.abs(err)).alias("MAE"),
        F.avg(F.abs(err) / F.greatest(F.abs("true"), F.lit(EPSILON))).alias("MAPE"),
        (1 - F.avg(err * err) / F.nullif(F.var_pop("true"), F.lit(0.0))).alias("R2"),
        correlation(F.col("pred"), F.col("true")).alias("Pearson_r"), correlation(F.col("rank_pred"), F.col("rank_true")).alias("Spearman_r"),
    )
    if pvalues:
        for name in ("Pearson", "Spearman"):
            out = correlation_pvalue(out, f"{name}_r", out=f"{name}_p")
    return out


def rc_average(df: DataFrame, tasks: Sequence[str], key: str = "id") -> DataFrame:
    """Per locus: mean of both strands' predictions, the label of either."""
    return df.groupBy(key).agg(
        *[F.avg(f"pred_{t}").alias(f"pred_{t}") for t in tasks], *[F.min(f"true_{t}").alias(f"true_{t}") for t in tasks], F.count("*").alias("n_strands")
    )


def mean_baselines(df: DataFrame, target: str, group: str = "motif", key: str = "id") -> DataFrame:
    """Test rows with the train mean and the train mean of their group (null for an unseen one)."""
    train = df.filter("split = 'train'")
    overall = train.agg(F.avg(target).alias("pred_mean"))
    by_group = train.groupBy(group).agg(F.avg(target).alias("pred_group_mean"))
    test = df.filter("split = 'test'").dropDuplicates([key])
    return test.crossJoin(F.broadcast(overall)).join(by_group, group, "left").select(key, group, F.col(target).alias("true"), "pred_mean", "pred_group_mean")


def best_run(metrics: DataFrame, metric: str, per: Sequence[str], pins: dict[str, str] | None = None, run: str = "run") -> DataFrame:
    """Best row of each group by a metric (errors: least; missing last); a pinned run wins where it exists."""
    value = F.when(F.isnan(metric), None).otherwise(F.col(metric))
    order = value.asc_nulls_last() if metric in ERRORS else value.desc_nulls_last()
    pinned = F.lit(1)
    for group, name in (pins or {}).items():
        pinned = F.when((F.concat_ws("|", *per) == group) & (F.col(run) == name), 0).otherwise(pinned)
    w = Window.partitionBy(*per).orderBy(pinned, order, run)
    return metrics.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class _Sample:
    """Rows (pred, true) of a group; scores of a resample given as the number of times that each row is drawn."""

    def __init__(self, pred: np.ndarray, true: np.ndarray):
        self.x = (pred, true)
        error = pred - true
        self.errors = error**2, np.abs(error), np.abs(error) / np.maximum(np.abs(true), EPSILON)
        self.ties = [np.unique(x, return_inverse=True)[1] for x in self.x]

    def scores(self, times: np.ndarray) -> tuple:
        n, times = times.sum(), times.astype(np.float64)
        mean = lambda v: float(times @ v / n)
        sizes = [np.bincount(t, times) for t in self.ties]
        varied = [np.count_nonzero(s) > 1 for s in sizes]
        mse, mae, mape = map(mean, self.errors)
        r2 = pearson = spearman = None
        if varied[1]:
            r2 = 1 - mse / mean((self.x[1] - mean(self.x[1])) ** 2)
        if all(varied):
            ranks = [(np.cumsum(s) - (s - 1) / 2)[t] for s, t in zip(sizes, self.ties, strict=True)]
            both = []
            for a, b in (self.x, ranks):
                a, b = a - mean(a), b - mean(b)
                both.append(mean(a * b) / math.sqrt(mean(a * a) * mean(b * b)))
            pearson, spearman = both
        return mse, mae, mape, r2, pearson, spearman


#: Sums over drawn rows that give all metrics but Spearman_r; labels and predictions are taken from their group's means.
SUMS = ("square", "absolute", "relative", "t", "tt", "p", "pp", "pt")


def _of_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, _v) of a row per group with an array per sum and _k drawn rows. Without spread, R2 and Pearson_r are NaN."""
    each = F.transform(F.arrays_zip(*SUMS), lambda z: F.struct(*[(z[n] / F.col("_k")).alias(n) for n in SUMS]))
    rows = rows.withColumn("_z", each)
    nan, tiny = F.lit(float("nan")), 1e-13

    def spread(square: Column, mean: Column) -> Column:
        var = square - mean * mean
        return F.when(var > square * tiny, var)

    def vector(f) -> Column:
        return F.transform("_z", lambda z: F.coalesce(f(z), nan))

    values = {
        "MSE": vector(lambda z: z["square"]), "MAE": vector(lambda z: z["absolute"]), "MAPE": vector(lambda z: z["relative"]),
        "R2": vector(lambda z: 1 - z["square"] / spread(z["tt"], z["t"])),
        "Pearson_r": vector(lambda z: (z["pt"] - z["p"] * z["t"]) / F.sqrt(spread(z["tt"], z["t"]) * spread(z["pp"], z["p"]))),
    }
    return rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("_v")) for m, v in values.items()])).alias("s")).select(*by, "s.*")


#: Rows of a group of which a task holds the order, about 50 bytes a row; drawn rows of larger groups are ranked through an exchange.
RANK_ROWS = 1 << 23
#: Rows whose ranks are multiplied at once.
RANK_PART = 1 << 16


class _Order:
    """The order of a group's rows by predictions and by labels, given as codes that sort as these do; Spearman's r of resamples of the rows."""

    def __init__(self, pred: np.ndarray, true: np.ndarray):
        self.by, self.ties = [], []
        for code in (pred, true):
            order = np.argsort(code, kind="stable").astype(np.int32)
            code = code[order]
            new = np.r_[True, code[1:] != code[:-1]]
            at = np.flatnonzero(new).astype(np.int32)
            sizes = np.diff(np.append(at, np.int32(len(code))))
            self.by.append(order)
            self.ties.append(None if new.all() else (np.repeat(at, sizes), np.repeat(at + sizes, sizes)))
        place = np.empty(len(pred), np.int32)
        place[self.by[1]] = np.arange(len(pred), dtype=np.int32)
        self.across = place[self.by[0]]

    def spearman(self, drawn: np.ndarray) -> float:
        """Of rows drawn as often as stated; NaN without spread."""
        n = int(drawn.sum())
        drawn = drawn.astype(np.uint8 if drawn.max() < 256 else np.int64)  # small numbers stay in the cache
        kind = np.int32 if n < 2**30 else np.int64
        found = []
        for order, ties in zip(self.by, self.ties, strict=True):
            taken = drawn[order]
            twice = np.cumsum(taken, dtype=kind)
            if ties is None:
                twice *= 2
                twice -= taken.astype(kind, copy=False)
            else:
                upto = np.append(kind(0), twice)
                twice = upto[ties[0]] + upto[ties[1]]
            twice -= kind(n)  # two midranks less n + 1, their mean
            found.append((taken, twice))
        (taken, a), (taken_b, b) = found
        sums = np.zeros(3)
        for i in range(0, len(a), RANK_PART):
            at = slice(i, i + RANK_PART)
            x, y = a[at].astype(np.float64), b[at].astype(np.float64)
            weighted = taken[at] * x
            sums += weighted @ x, (taken_b[at] * y) @ y, weighted @ b[self.across[at]].astype(np.float64)
        return float(sums[2] / math.sqrt(sums[0] * sums[1])) if sums[0] > 0 and sums[1] > 0 else math.nan


def _piece_ranks(dealt: DataFrame, info: DataFrame, by: Sequence[str], n_boot: int, seed: int, frac: float) -> DataFrame:
    """(by, metric, _v) of Spearman_r for groups of several pieces and at most RANK_ROWS rows.

    Ranks are found once for all rows and packed by piece, in the order of the draws. A task gets a group's packed ranks and repeats
    the draws of all its pieces for some replicates: no drawn row is moved.
    """
    ranked = avg_ranks(join_same(dealt, info.select(*by).distinct(), by, "inner"), {"pred": "rank_pred", "true": "rank_true"}, by)
    rows = ranked.select(*by, "_piece", "_h", *[(F.floor(f"rank_{c}") - 1).cast("int").alias(c) for c in ("pred", "true")])  # tells values apart as ranks do
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((frame["true"], frame["pred"], frame["_h"]))]
        return pd.DataFrame([[*key, *(frame[c].to_numpy(np.int32).tobytes() for c in ("pred", "true"))]], columns=[*by, "_piece", "pred", "true"])

    packed = rows.groupBy(*by, "_piece").applyInPandas(pack, f"{kinds}_piece int, pred binary, true binary")
    packed = stored(join_same(packed, info.select(*by, "_piece", "_size", "_at", "_n", "_sizes"), [*by, "_piece"], "inner"))
    lots = max(1, min(n_boot, 256 // max(1, info.select(*by).distinct().count())))

    def score(key: tuple, pieces_: pd.DataFrame) -> pd.DataFrame:
        pieces_ = pieces_.sort_values("_at")
        codes = [np.concatenate([np.frombuffer(x, np.int32) for x in pieces_[c]]) for c in ("pred", "true")]
        about = [one for _, one in pieces_[["_piece", "_size", "_at", "_n", "_sizes"]].iterrows()]
        del pieces_
        order, k = _Order(*codes), drawn_size(len(codes[0]), frac)
        del codes
        found = [order.spearman(np.concatenate([times(seed, one, r, k) for one in about])) for r in range(int(key[-1]), n_boot, lots)]
        return pd.DataFrame([[*key[:-1], found]], columns=[*by, "_v"])

    dealt_out = packed.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    scored = dealt_out.groupBy(*by, "_lot").applyInPandas(score, f"{kinds}_v array<double>")
    return scored.groupBy(*by).agg(F.flatten(F.collect_list("_v")).alias("_v")).select(*by, F.lit("Spearman_r").alias("metric"), "_v")


def _drawn_ranks(dealt: DataFrame, info: DataFrame, by: Sequence[str], n_boot: int, seed: int, frac: float) -> DataFrame:
    """(by, metric, _v) of Spearman_r for groups of over RANK_ROWS rows: their drawn rows are ranked replicate by replicate."""
    lot = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate")
    left, right = (df.select("*", lot).groupBy(*by, "_piece", "replicate") for df in (join_same(dealt, info.select(*by).distinct(), by, "inner"), info))

    def draw(key: tuple, rows: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows["true"], rows["pred"], rows["_h"]))]
        one = about.iloc[0]
        at = np.repeat(np.arange(len(rows)), times(seed, one, int(key[-1]), drawn_size(int(one["_n"]), frac)))
        return rows[[*by, "replicate", "pred", "true"]].iloc[at]

    kinds = "".join(f"`{c}` {t}, " for c, t in dealt.select(*by).dtypes)
    drawn = left.cogroup(right).applyInPandas(draw, f"{kinds}replicate int, pred double, true double")
    names = [c for c in by if c != "task"]
    scored = regression_metrics(drawn.withColumnsRenamed({"pred": "pred_t", "true": "true_t", "task": "_task"}), [*names, "_task", "replicate"], ["t"]).drop("task").withColumnRenamed("_task", "task")
    return scored.groupBy(*by).agg(F.collect_list("Spearman_r").alias("_v")).select(*by, F.lit("Spearman_r").alias("metric"), "_v")


def bootstrap_metrics(df: DataFrame, tasks: Sequence[str], n_boot: int = 1000, level: float = 0.95, seed: int = 42, resample_frac: float = 1.0, key: str = "id", per: Sequence[str] = ()) -> DataFrame:
    """(per, task, metric, lo, hi, n_boot): percentile interval of every metric over resamples of each group's rows.

    `key` orders the rows of a group, by its hash. Rows with a missing value are left out of their task. Draws are the same
    whatever the group's size: a group of one piece is scored where it lies; of larger ones, pieces return sums by
    replicate, and Spearman's ranks are found by tasks that hold the ranks of all rows of a group (RANK_ROWS at most). The rows are written once, by a job of this call.
    """
    by = [*per, "task"]
    long = stored(long_predictions(df, tasks, [*per, key]).filter(present("pred", "true")).select(*by, F.xxhash64(key).alias("_h"), "pred", "true"))
    dealt, info = pieces(long, by)
    means = long.groupBy(*by).agg(F.avg("pred").alias("_mp"), F.avg("true").alias("_mt"))
    info = stored(join_same(info, means, by, "inner"))

    def replicate(group: tuple, rows: pd.DataFrame, about: pd.Series, replicates: range):
        pred, true = (rows[c].to_numpy(np.float64) for c in ("pred", "true"))
        order = np.lexsort((true, pred, rows["_h"].to_numpy()))
        pred, true = pred[order], true[order]
        k = drawn_size(int(about["_n"]), resample_frac)
        drawn = (times(seed, about, r, k) for r in replicates)
        if len(about["_sizes"]) == 1:
            sample = _Sample(pred, true)
            named = zip(METRICS, np.array([[math.nan if x is None else x for x in sample.scores(w)] for w in drawn]).T, strict=True)
        else:
            error, t, p = pred - true, true - about["_mt"], pred - about["_mp"]
            sums = np.stack([error**2, np.abs(error), np.abs(error) / np.maximum(np.abs(true), EPSILON), t, t * t, p, p * p, p * t])
            named = zip(SUMS, np.stack([sums @ w for w in drawn], axis=1), strict=True)
        for name, v in named:
            yield {**dict(zip(by, group, strict=True)), "metric": name, "_sums": v}

    kinds = "".join(f"`{c}` {t}, " for c, t in long.select(*by).dtypes)
    whole = whole_vectors(in_pieces(dealt, info, by, n_boot, replicate, f"{kinds}metric string, _vector int, _sums array<double>"), [*by, "metric"])
    several = info.filter(F.size("_sizes") > 1)
    if not several.isEmpty():
        whole = stored(whole)
        size = F.greatest(F.least(F.col("_n"), F.lit(10)), F.floor(F.col("_n") * resample_frac))
        sums = whole.filter(F.col("metric").isin(*SUMS)).groupBy(*by).pivot("metric", list(SUMS)).agg(F.first("_v"))
        sums = join_same(sums, several.select(*by, size.alias("_k")).distinct(), by, "inner")
        whole = whole.filter(F.col("metric").isin(*METRICS)).unionByName(_of_sums(sums, by))
        for ranks, some in ((_piece_ranks, several.filter(F.col("_n") <= RANK_ROWS)), (_drawn_ranks, several.filter(F.col("_n") > RANK_ROWS))):
            if not some.isEmpty():
                whole = whole.unionByName(ranks(dealt, some, by, n_boot, seed, resample_frac))
    return with_interval(whole, F.col("_v"), [*by, "metric"], level)


def _wide_intervals(intervals: DataFrame, per: Sequence[str]) -> DataFrame:
    """<metric>_lo and <metric>_hi as columns."""
    pick = lambda m, end: F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}")
    return intervals.groupBy(*per).agg(*[pick(m, end) for m in METRICS for end in ("lo", "hi")])


def metric_by_flank(df: DataFrame, tasks: Sequence[str], select_metric: str = "Spearman_r", per: Sequence[str] = ("motif_len", "flank"), run: str = "run", n_boot: int = 1000,
                    level: float = 0.95, seed: int = 42, key: str = "id") -> DataFrame:
    """Metrics of the best run of each motif length and flank size, per task, with bootstrap intervals of that run's metrics.

    `n_boot` 0 leaves the intervals out.
    """
    won = best_run(regression_metrics(df, [*per, run], tasks, pvalues=True), select_metric, [*per, "task"], run=run)
    if not n_boot:
        return won
    ci = bootstrap_metrics(df.join(won.select(*per, run).distinct(), [*per, run], "left_semi"), tasks, n_boot, level, seed, key=key, per=[*per, run])
    return won.join(_wide_intervals(ci, [*per, run, "task"]), [*per, run, "task"], "left")


def flank_of_run(run: Column) -> tuple[Column, Column]:
    """(motif length, flank size) that a run's name states, such as str4_f2500_...; null where it does not."""
    part = lambda p: F.nullif(F.regexp_extract(run, p, 1), F.lit("")).try_cast("long")
    return part(r"^str(\d+)_f\d+(?:_|$)"), part(r"^str\d+_f(\d+)(?:_|$)")


def metric_by_model_type(df: DataFrame, tasks: Sequence[str], series: dict[str, str], run: str = "run", per: Sequence[str] = (), n_boot: int = 1000, level: float = 0.95, seed: int = 42,
                         resample_frac: float = 1.0, key: str = "id") -> DataFrame:
    """Metrics with bootstrap intervals of the runs that `series` (run: series) names; runs of one series stay rows of their own.

    Runs without the columns of a task have null predictions for it and no row.
    """
    if not series:
        raise ValueError("series is empty")
    names = F.create_map(*[F.lit(x) for pair in series.items() for x in pair])
    rows = df.withColumn("series", names[F.col(run)]).filter("series is not null")
    by = [*per, "series", run]
    scored = regression_metrics(rows, by, tasks, pvalues=True)
    if not n_boot:
        return scored
    ci = bootstrap_metrics(rows, tasks, n_boot, level, seed, resample_frac, key, by)
    return scored.join(_wide_intervals(ci, [*by, "task"]), [*by, "task"], "left")


def leaderboard(metrics: DataFrame, metric: str = "MSE", per: str = "task") -> DataFrame:
    """Runs ranked best first for each task; the model type follows from the run's number of tasks."""
    n = F.count("*").over(Window.partitionBy("run"))
    kind = F.when(F.col("run").startswith("mean"), "mean").when(F.col("run").startswith("linear"), "linear").when(n > 1, "multi_task").otherwise("single_task")
    order = F.col(metric).asc_nulls_last() if metric in ERRORS else F.col(metric).desc_nulls_last()
    return metrics.withColumn("model_type", kind).withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy(order, "run")))


def metric_by_length(metrics: DataFrame, metric: str = "Spearman_r", pins: dict[int, str] | None = None) -> DataFrame:
    """Best run of each series (model, linear, mean) by task and motif length, one column per series.

    `pins` names the run that stands for its series at a motif length, where it exists.
    """
    series = F.when(F.col("run").startswith("mean"), "mean").when(F.col("run").startswith("linear"), "linear").otherwise("model")
    pinned = F.lit(0)
    for length, name in (pins or {}).items():
        pinned = F.when((F.col("motif_len") == length) & (F.col("run") == name), 1).otherwise(pinned)
    by = ["task", "motif_len", "series"]
    rows = metrics.withColumn("series", series).withColumn("_pin", pinned).withColumn("_any", F.max("_pin").over(Window.partitionBy(*by)))
    best = best_run(rows.filter(F.col("_pin") == F.col("_any")), metric, by)
    return best.groupBy("task", "motif_len").pivot("series", ["model", "linear", "mean"]).agg(F.first(metric))


def target_variance(train: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Population variance of each transformed target: at least 1e-8, 1 for an empty table."""
    each = [
        F.struct(F.lit(t).alias("target"), F.greatest(F.coalesce(F.var_pop(target_transform(F.col(t).cast("double"), name)), F.lit(1.0)), F.lit(1e-8)).alias("variance"))
        for t, name in targets.items()
    ]
    return train.agg(F.array(*each).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def fixed_variance_score(df: DataFrame, variances: DataFrame, targets: dict[str, str]) -> DataFrame:
    """One row: the sum over tasks of the training-space MSE over the target's variance."""
    long = None
    for t, name in targets.items():
        err = target_transform(F.col(f"pred_{t}").cast("double"), name) - target_transform(F.col(f"true_{t}").cast("double"), name)
        one = df.select(F.lit(t).alias("target"), (err * err).alias("sq"))
        long = one if long is None else long.unionByName(one)
    mse = long.groupBy("target").agg(F.avg("sq").alias("mse"))
    return mse.join(variances, "target").agg(F.sum(F.col("mse") / F.col("variance")).alias("score"))
