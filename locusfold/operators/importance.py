"""Region permutation importance: regions, shuffles, effects, profiles, reach and clusters."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import METRICS, regression_metrics
from .model import loaded
from .ranks import present
from .resampling import bootstrap_interval


def layout(spark: SparkSession, n_flank: int, n_prefix: int = 0, n_str: int = 0, n_gap: int = 0) -> DataFrame:
    """One row: the sizes of the parts of a model's input."""
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("n_flank", n_flank), ("n_prefix", n_prefix), ("n_str", n_str), ("n_gap", n_gap))])


def flank_regions(layouts: DataFrame, width: int, max_flank_bp: int | None = None) -> DataFrame:
    """Regions of each flank from the repeat outward, a smaller rest at the far end: token and distance ranges.

    `layouts` has n_flank, n_prefix, n_str, n_gap; each row gives regions of its own beside its other columns.
    """
    sizes = ("n_flank", "n_prefix", "n_str", "n_gap")
    rows = layouts.withColumn("region_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_flank") / width) - 1))).filter("region_idx * %d < n_flank" % width)
    lo, hi = F.col("distance_start"), F.col("distance_end")
    rows = rows.withColumn("distance_start", F.col("region_idx") * width).withColumn("distance_end", F.least(lo + width, F.col("n_flank")).cast("long"))
    if max_flank_bp is not None:
        rows = rows.filter(hi <= max_flank_bp)
    at = F.col("n_prefix") + F.col("n_flank")
    right = at + 2 * F.col("n_str") + F.col("n_gap")
    side = lambda name, k, a, b: F.struct(F.lit(name).alias("flank"), (2 * F.col("region_idx") + k).alias("region_id"), a.cast("long").alias("token_start"), b.cast("long").alias("token_end"))
    both = F.explode(F.array(side("left", 0, at - hi, at - lo), side("right", 1, right + lo, right + hi)))
    kept = [c for c in layouts.columns if len(layouts.columns) > len(sizes) or c not in sizes]
    return rows.withColumn("s", both).select(*kept, "s.flank", "region_idx", "s.region_id", "s.token_start", "s.token_end", "distance_start", "distance_end")


def shuffle_region(seq: Column, start: Column, end: Column, seed: int, *keys: str) -> Column:
    """The string with the bases in [start, end) in the order of a hash of (seed, keys, position)."""
    part = F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))
    places = F.sequence(F.lit(1).cast("long"), end - start)
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    drawn = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws("|", key, i.cast("string"))).alias("h"), F.substring(part, i.cast("int"), F.lit(1)).alias("b"))))
    mixed = F.array_join(F.transform(drawn, lambda x: x["b"]), "")
    return F.concat(F.substring(seq, F.lit(1), start.cast("int")), F.when(end > start, mixed).otherwise(""), F.substring(seq, (end + 1).cast("int"), F.length(seq)))


def perturbed_predictions(samples: DataFrame, regions: DataFrame, n_perm: int, scorer, seed: int = 42, seq: str = "input") -> DataFrame:
    """(id, rev_comp, region_id, perm, baseline, permuted): `scorer` maps a sequence column to a prediction column.

    Samples meet the bounded region table by an explode; every perturbed sequence lives in its row only, and a sample's
    baseline is scored once, before. For models that score batches, see `perturbed_scores`.
    """
    samples = samples.withColumn("_baseline", scorer(F.col(seq)))
    plan = regions.select(F.collect_list(F.struct("region_id", "token_start", "token_end")).alias("regions"))  # the region table is one short array
    rows = samples.crossJoin(F.broadcast(plan)).withColumn("r", F.explode("regions")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    rows = rows.withColumn("region_id", F.col("r.region_id"))
    mixed = shuffle_region(F.col(seq), F.col("r.token_start"), F.col("r.token_end"), seed, "id", "rev_comp", "region_id", "perm")
    return rows.withColumn("_mixed", mixed).select("id", "rev_comp", "region_id", "perm", F.col("_baseline").alias("baseline"), scorer(F.col("_mixed")).alias("permuted"))


def shuffled(seq: str, start: int, end: int, seed: int, *keys) -> str:
    """`shuffle_region` of one string: the same order of the same hashes."""
    text = "|".join([str(seed), *(str(k).lower() if isinstance(k, bool) else str(k) for k in keys if k is not None)])
    part = seq[start:end]
    drawn = sorted((hashlib.md5(f"{text}|{i}".encode()).hexdigest(), b) for i, b in enumerate(part, 1))
    return seq[:start] + "".join(b for _, b in drawn) + seq[end:]


def perturbed_scores(samples: DataFrame, regions: DataFrame, n_perm: int, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], tasks: Sequence[str], seed: int = 42, seq: str = "input",
                     at_once: int = 256) -> DataFrame:
    """(id, rev_comp, task, region_id, perm, baseline, permuted) by a model that scores batches.

    `load()` gives a scorer as `batch_score` takes it, once in each Python worker: of a frame with id, rev_comp and `seq` it
    returns a frame with a column per task, row by row. Permuted inputs are made inside the batch, `at_once` at a time, and a
    sample's baseline is scored once: it costs 1 + regions x permutations evaluations. A sample without input has null
    scores. The region table is a short array that reaches the driver.
    """
    plan = [(r.region_id, r.token_start, r.token_end, p) for r in regions.select("region_id", "token_start", "token_end").orderBy("region_id").collect() for p in range(n_perm)]
    token = uuid.uuid4().hex
    kinds = dict(samples.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = loaded(token, load)
        for f in frames:
            for one in f.itertuples(index=False):
                text = getattr(one, seq)
                scored = []
                jobs = [None, *plan]
                for at in range(0, len(jobs) if text is not None else 0, at_once):
                    inputs = [text if j is None else shuffled(text, j[1], j[2], seed, one.id, one.rev_comp, j[0], j[3]) for j in jobs[at:at + at_once]]
                    given = pd.DataFrame({"id": [one.id] * len(inputs), "rev_comp": [one.rev_comp] * len(inputs), seq: inputs})
                    scored.append(scorer(given)[list(tasks)].to_numpy(np.float64))
                values = np.concatenate(scored) if scored else np.full((len(jobs), len(tasks)), np.nan)
                n = len(plan)
                yield pd.DataFrame({
                    "id": [one.id] * n * len(tasks), "rev_comp": [one.rev_comp] * n * len(tasks), "task": np.repeat(list(tasks), n), "region_id": [j[0] for j in plan] * len(tasks),
                    "perm": [j[3] for j in plan] * len(tasks), "baseline": np.repeat(values[0], n), "permuted": values[1:].T.ravel(),
                })

    schema = f"id {kinds['id']}, rev_comp {kinds['rev_comp']}, task string, region_id long, perm int, baseline double, permuted double"
    out = samples.select("id", "rev_comp", seq).mapInPandas(run, schema)
    return out.withColumns({c: F.when(present(c), F.col(c)) for c in ("baseline", "permuted")})


def delta_summary(perturbed: DataFrame, per: Sequence[str] = ("task",)) -> DataFrame:
    d = F.abs(F.col("permuted") - F.col("baseline"))
    return perturbed.groupBy(*per).agg(F.avg(d).alias("mean_abs_delta"), F.max(d).alias("max_abs_delta"), F.count("*").alias("n"))


def _abs_pct(perturbed: DataFrame, keys: Sequence[str], log_space: bool = False) -> DataFrame:
    b, p = F.col("baseline"), F.col("permuted")
    if log_space:
        b, p = F.expm1(b), F.expm1(p)
    change = 100 * (p - b) / F.nullif(b, F.lit(0.0))
    return perturbed.groupBy(*keys).agg(F.abs(F.avg(change)).alias("abs_pct"))


def local_effect(perturbed: DataFrame, log_space: bool = False) -> DataFrame:
    """Mean over loci of the absolute mean percent change, by region; zero baselines are left out and counted."""
    each = _abs_pct(perturbed, ["region_id", "id", "rev_comp"], log_space)
    return each.groupBy("region_id").agg(F.avg("abs_pct").alias("local_mean"), F.stddev_samp("abs_pct").alias("local_std"), F.count("abs_pct").alias("n"), F.count_if(F.col("abs_pct").isNull()).alias("n_zero"))


def local_effect_ci(perturbed: DataFrame, n_boot: int = 10000, level: float = 0.95, seed: int = 42, log_space: bool = False) -> DataFrame:
    """Percentile interval of `local_effect`'s mean by region over resamples of its rows."""
    each = _abs_pct(perturbed, ["region_id", "id", "rev_comp"], log_space).filter("abs_pct is not null")
    keyed = each.select("region_id", F.struct("id", "rev_comp").alias("row"), "abs_pct")
    return bootstrap_interval(keyed, "abs_pct", "row", n_boot, seed, ["region_id"], level).drop("n_boot")


def global_effect(perturbed: DataFrame, truth: DataFrame) -> DataFrame:
    """Per region the mean change of each metric over permutations, signed so that positive means that the region matters."""
    rows = perturbed.join(truth, ["id", "rev_comp"])
    base = regression_metrics(rows.filter("region_id = 0 and perm = 0").select(F.lit(1).alias("g"), F.col("baseline").alias("pred_t"), F.col("true").alias("true_t")), ["g"], ["t"])
    each = regression_metrics(rows.select("region_id", "perm", F.col("permuted").alias("pred_t"), F.col("true").alias("true_t")), ["region_id", "perm"], ["t"])
    base = base.select(*[F.col(m).alias(f"base_{m}") for m in METRICS])
    sign = {m: 1 if m in ("MSE", "MAE", "MAPE") else -1 for m in METRICS}
    return each.crossJoin(F.broadcast(base)).groupBy("region_id").agg(*[F.avg(sign[m] * (F.col(m) - F.col(f"base_{m}"))).alias(f"d_{m}") for m in METRICS])  # one base row


def region_table(regions: DataFrame, local: DataFrame, global_: DataFrame) -> DataFrame:
    return regions.withColumn("midpoint", (F.col("distance_start") + F.col("distance_end")) / 2).join(local, "region_id", "left").join(global_, "region_id", "left")


def top_regions(table: DataFrame, values: Sequence[str] = ("local_mean", "d_Spearman_r"), n: int = 10) -> DataFrame:
    """(ranking, place, table's columns): the `n` largest regions by each value, ties by region; regions without the value have no place."""
    out = None
    for v in values:
        rows = table.filter(present(v)).orderBy(F.desc(v), "region_id").limit(n)
        place = F.row_number().over(Window.orderBy(F.desc(v), "region_id")).alias("place")  # n rows
        one = rows.select(F.lit(v).alias("ranking"), place, *table.columns)
        out = one if out is None else out.unionByName(one)
    return out


def flank_summary(table: DataFrame, values: Sequence[str] = ("local_mean", "d_Spearman_r")) -> DataFrame:
    """(flank, value, n_regions, max, mean, min, and the region_idx, distance_start and distance_end of the largest, the first of equal ones)."""
    each = [F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values]
    where = F.struct("region_idx", "distance_start", "distance_end")
    rows = table.select("flank", where.alias("w"), F.explode(F.array(*each)).alias("s")).select("flank", "w", "s.*")
    known = F.when(present("x"), F.col("x"))
    out = rows.groupBy("flank", "value").agg(
        F.count("*").alias("n_regions"), F.max(known).alias("max"), F.avg(known).alias("mean"), F.min(known).alias("min"),
        F.max_by("w", F.when(present("x"), F.struct("x", -F.col("w.region_idx")))).alias("w"),
    )
    return out.select("flank", "value", "n_regions", "max", "mean", "min", "w.*")


def left_right_compare(table: DataFrame, value: str = "local_mean") -> DataFrame:
    return table.groupBy("region_idx").agg(
        F.max(F.when(F.col("flank") == "left", F.col(value))).alias("left_value"), F.max(F.when(F.col("flank") == "right", F.col(value))).alias("right_value")
    ).filter("left_value is not null and right_value is not null").withColumn("difference", F.col("left_value") - F.col("right_value"))


def genomic_profile(perturbed: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, side, region_idx, value) averaged over strands, ids that lack a strand): a reverse row's left flank lies downstream."""
    each = _abs_pct(perturbed, ["id", "rev_comp", "region_id"]).join(F.broadcast(regions.select("region_id", "flank", "region_idx", "distance_start", "distance_end")), "region_id")
    strands = perturbed.groupBy("id").agg(F.countDistinct("rev_comp").alias("n"))
    up = (F.col("flank") == "left") != F.col("rev_comp")
    out = each.join(strands.filter("n = 2").select("id"), "id", "left_semi").groupBy(
        "id", F.when(up, "up").otherwise("down").alias("side"), "region_idx", ((F.col("distance_start") + F.col("distance_end")) / 2).alias("midpoint")
    ).agg(F.avg("abs_pct").alias("value"))
    return out, strands.filter("n < 2").select("id")


def profile_mean(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("side", "region_idx", "midpoint").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def profile_mean_ci(profiles: DataFrame, n_boot: int = 10000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """`profile_mean` with the percentile interval of every mean over resamples of the loci."""
    by = ["side", "region_idx"]
    rows = profiles.filter(present("value")).select(*by, "id", "value")
    ci = bootstrap_interval(rows, "value", "id", n_boot, seed, by, level).drop("n_boot")
    return profile_mean(profiles).join(ci, by, "left")


def profile_overlay(means: DataFrame, per: Sequence[str] = ("side",)) -> DataFrame:
    """Each mean profile over its own maximum (a maximum of 0 counts as 1)."""
    top = F.max("mean").over(Window.partitionBy(*per))
    return means.withColumn("scaled", F.col("mean") / F.when(top == 0, 1.0).otherwise(top))


def reach_metrics(profiles: DataFrame, far_bp: float = 1000, quantile: float = 0.90, key: str = "id") -> DataFrame:
    """Centre of mass, share beyond `far_bp`, first distance with the cumulative share (the last one if rounding
    keeps it below); an all-zero profile gives zeros. `profiles` has id, midpoint, value."""
    rows = profiles.withColumn("w", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    upto = F.sum("w").over(Window.partitionBy(key).orderBy("midpoint"))
    total = F.sum("w").over(Window.partitionBy(key))
    rows = rows.withColumn("total", total).withColumn("share", upto / F.nullif(F.col("total"), F.lit(0.0)))
    return rows.groupBy(key).agg(
        F.coalesce(F.sum(F.col("w") * F.col("midpoint")) / F.nullif(F.max("total"), F.lit(0.0)), F.lit(0.0)).alias("center_of_mass"),
        F.coalesce(F.sum(F.when(F.col("midpoint") > far_bp, F.col("w")).otherwise(0.0)) / F.nullif(F.max("total"), F.lit(0.0)), F.lit(0.0)).alias("frac_beyond"),
        F.when(F.max("total") > 0, F.coalesce(F.min(F.when(F.col("share") >= quantile, F.col("midpoint"))), F.max("midpoint"))).otherwise(0.0).alias("reach_distance"),
    )


def unit_area(profile: Column) -> Column:
    """A profile clipped at 0 over its sum; null if the sum is 0."""
    w = F.transform(profile, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(w, lambda x: x / F.nullif(total, F.lit(0.0))))


def _features(df: DataFrame, col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.filter(F.col(col).isNotNull()).withColumn("features", array_to_vector(col))


def profile_kmeans(df: DataFrame, k: int = 3, seed: int = 42, starts: int = 4, col: str = "unit") -> DataFrame:
    """`df` with the cluster of the cheapest of several starts; rows without a profile get -2."""
    from pyspark.ml.clustering import KMeans

    rows = _features(df, col).persist()
    models = [KMeans(k=k, seed=seed + i).fit(rows) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).drop("features").withColumnRenamed("prediction", "cluster").unionByName(df.filter(F.col(col).isNull()).withColumn("cluster", F.lit(-2)))


def silhouette_sweep(df: DataFrame, ks: Sequence[int] = tuple(range(2, 8)), seed: int = 42, col: str = "unit") -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _features(df, col).persist()
    found = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(rows).transform(rows)))) for k in ks]
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, silhouette double")


def long_range_cluster(labels: DataFrame, reach: DataFrame, key: str = "id") -> DataFrame:
    """Members of the cluster with the largest mean centre of mass, in order of their own."""
    joined = labels.filter("cluster >= 0").join(reach, key)
    best = joined.groupBy("cluster").agg(F.avg("center_of_mass").alias("m"), F.count("*").alias("cluster_size"))
    top = best.orderBy(F.desc("m"), "cluster").limit(1).select("cluster", "cluster_size")
    return joined.join(F.broadcast(top), "cluster").select(key, "cluster", "cluster_size", "center_of_mass").orderBy(F.desc("center_of_mass"), key)  # one row joins


def cluster_examples(df: DataFrame, n: int = 5, key: str = "id", col: str = "unit") -> DataFrame:
    """The n members nearest their cluster's mean profile."""
    means = df.filter(F.col(col).isNotNull()).select("cluster", F.posexplode(col).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    d = F.aggregate(F.zip_with(col, F.transform("c", lambda s: s["m"]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    near = df.filter(F.col(col).isNotNull()).join(centres, "cluster").withColumn("distance", F.sqrt(d))
    w = Window.partitionBy("cluster").orderBy("distance", key)
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("cluster", "place", key, "distance")
