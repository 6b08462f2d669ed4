"""Mining of attribution arrays: pairing, averaging, k-mers by distance, permutation tests, correction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import avg_rank, avg_ranks, exact_quantiles, join_same, present
from .resampling import bootstrap_interval, dealt_sums, in_pieces, permuted_places, pieces, whole_vectors
from .sequence import canonical_kmer
from .staging import stored


def relative_delta(delta: Column, difference: Column, eps: float = 1e-6) -> Column:
    size = F.abs(difference)
    return F.abs(delta) / F.when(size <= eps, 1.0).otherwise(size)


def convergence_summary(df: DataFrame, per: Sequence[str] = ("task",), cuts: Sequence[float] = (0.05, 0.01)) -> DataFrame:
    """Summary of |delta|, relative delta and prediction difference per group."""
    rows = df.select(*per, F.abs("delta").alias("delta"), relative_delta(F.col("delta"), F.col("pred") - F.col("base")).alias("rel"), (F.col("pred") - F.col("base")).alias("diff"))
    rows = rows.withColumns({c: F.when(present(c), F.col(c)) for c in ("delta", "rel", "diff")})
    aggs = [F.count("*").alias("n")]
    for c in ("delta", "rel"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.stddev_pop(c).alias(f"{c}_std")]
    aggs += [(100.0 * F.count_if(F.col("rel") > cut) / F.count("*")).alias(f"pct_over_{round(cut * 100)}") for cut in cuts]
    aggs += [F.avg("diff").alias("diff_mean"), F.min("diff").alias("diff_min"), F.max("diff").alias("diff_max")]
    out = rows.groupBy(*per).agg(*aggs)
    for c in ("delta", "rel", "diff"):
        out = join_same(out, exact_quantiles(rows, c, {f"{c}_median": 0.5}, per), per)
    return out


def informative_summary(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    flag = F.abs(F.col("pred") - F.col("base")) > threshold
    return convergence_summary(df.withColumn("informative", flag), ["task", "informative"])


def method_sweep(runs: DataFrame, cut: float = 0.05) -> DataFrame:
    """Share of rows over a relative delta by task, method and steps."""
    r = relative_delta(F.col("delta"), F.col("pred") - F.col("base"))
    return runs.groupBy("task", "method", "n_steps").agg(F.count("*").alias("n"), (100.0 * F.count_if(r > cut) / F.count("*")).alias("pct_over")).orderBy("task", "method", "n_steps")


def filter_samples(df: DataFrame, pred_diff: float = 0.0, rel_delta: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts of what each filter drops in turn). A missing value is never a reason to drop."""
    small = F.coalesce(F.abs(F.col("pred") - F.col("base")) <= pred_diff, F.lit(False)) if pred_diff > 0 else F.lit(False)
    rough = F.coalesce(relative_delta(F.col("delta"), F.col("pred") - F.col("base")) > rel_delta, F.lit(False)) if rel_delta is not None else F.lit(False)
    counters = df.agg(F.count("*").alias("n_total"), F.count_if(small).alias("n_small_diff"), F.count_if(~small & rough).alias("n_rough"), F.count_if(~small & ~rough).alias("n_kept"))
    return df.filter(~small & ~rough), counters


def pair_strands(df: DataFrame, cols: Sequence[str], key: str = "id", rc: str = "rev_comp") -> DataFrame:
    """One row per id that has both strands: fwd_<col> and rc_<col>."""
    row = F.struct(*cols)
    both = df.groupBy(key).agg(F.max(F.when(~F.col(rc), row)).alias("f"), F.max(F.when(F.col(rc), row)).alias("r")).filter("f is not null and r is not null")
    return both.select(key, *[F.col(f"f.{c}").alias(f"fwd_{c}") for c in cols], *[F.col(f"r.{c}").alias(f"rc_{c}") for c in cols])


def normalize_attr(attr: Column, difference: Column) -> Column:
    """Attributions over the signed prediction difference; null where that is 0."""
    return F.transform(attr, lambda x: x / F.nullif(difference, F.lit(0.0)))


def strand_average(pairs: DataFrame, n_left: int, n_right: int, absolute: bool = False, fwd: str = "fwd_attr", rc: str = "rc_attr") -> DataFrame:
    """`left` and `right` flank averages in genomic coordinates: forward and flipped reverse strand."""
    f, r = F.col(fwd), F.col(rc)
    if absolute:
        f, r = F.transform(f, F.abs), F.transform(r, F.abs)
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    left, right = lambda a: F.slice(a, 1, n_left), lambda a: F.slice(a, F.size(a) - n_right + 1, n_right)
    return pairs.withColumn("left", mean(left(f), F.reverse(right(r)))).withColumn("right", mean(right(f), F.reverse(left(r))))


def position_profile(df: DataFrame, attr: str = "attr") -> DataFrame:
    """Mean absolute value by position."""
    return df.select(F.posexplode(attr).alias("pos", "x")).groupBy("pos").agg(F.avg(F.abs("x")).alias("mean_abs"), F.count("x").alias("n"))


def position_profile_ci(df: DataFrame, n_boot: int = 1000, level: float = 0.95, seed: int = 42, attr: str = "attr", key: Sequence[str] = ("id", "rev_comp")) -> DataFrame:
    """Percentile interval of `position_profile` over resamples of the rows."""
    rows = df.select(F.struct(*key).alias("row"), F.posexplode(attr).alias("pos", "x")).withColumn("x", F.abs("x")).filter(present("x"))
    return bootstrap_interval(rows, "x", "row", n_boot, seed, ["pos"], level).drop("n_boot")


def smooth_profile(profile: DataFrame, window: int, value: str = "mean_abs", flank: str = "flank", pos: str = "pos") -> DataFrame:
    """Centred moving sum over `window` positions of a flank, divided by the window; edges shrink."""
    if window <= 1:
        return profile.withColumn("smooth", F.col(value))
    w = Window.partitionBy(flank).orderBy(pos).rowsBetween(-(window // 2), (window - 1) // 2)
    return profile.withColumn("smooth", F.sum(value).over(w) / window)


def relative_axis(pos: Column, n_left: int, n_middle: int) -> Column:
    """Signed distance from the repeat of a flank position; null inside the repeat."""
    return F.when(pos < n_left, pos - n_left).when(pos >= n_left + n_middle, pos - n_left - n_middle + 1)


def kmer_occurrences(averaged: DataFrame, k: int, n_left: int, n_right: int, max_distance: int | None = None, seq: str = "sequence", motif_class: str = "motif_class") -> DataFrame:
    """(distance, ig_score, kmer, motif_class): k bases from each distance outward on both flanks with their mean attribution.

    A row's windows are taken where it lies, in one pass over its flanks. A window with a missing attribution, or beyond
    the end of an array, has a null score; a row without sequence has null k-mers.
    """
    far = min(max_distance or n_left, n_left - k + 1, n_right - k + 1)
    distance = np.arange(1, far + 1, dtype=np.int32)
    inner = n_left - distance - k + 1  # first place of the left windows

    def means(values: pa.Scalar, first: np.ndarray, size: int) -> np.ndarray:
        x = np.full(size, np.nan)
        if values.is_valid:
            own = values.values.to_numpy(zero_copy_only=False)[:size]
            x[:len(own)] = own
        return np.lib.stride_tricks.sliding_window_view(x, k)[first].mean(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                scores, words = [], []
                for left, right, text in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                    scores += [means(left, inner, n_left), means(right, distance - 1, n_right)]
                    starts = np.concatenate([inner, len(text or "") - n_right + distance - 1]).tolist()
                    words += [None] * len(starts) if text is None else [text[i:i + k] for i in starts]
                row = np.repeat(np.arange(b.num_rows), 2 * far)
                score = pa.array(np.concatenate(scores), pa.float64(), from_pandas=True)  # NaN becomes null
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(distance, 2 * b.num_rows)), score, pa.array(words, pa.string()), b.column(3).take(pa.array(row))], ["distance", "ig_score", "w", motif_class])

    if far < 1:
        raise ValueError("no distance leaves room for a k-mer on both flanks")
    given = averaged.select(F.col("left").cast("array<double>").alias("left"), F.col("right").cast("array<double>").alias("right"), seq, F.col(motif_class).cast("string").alias(motif_class))
    found = given.mapInArrow(run, f"distance int, ig_score double, w string, `{motif_class}` string")
    return found.select("distance", "ig_score", canonical_kmer(F.col("w")).alias("kmer"), motif_class)


def rank_candidates(pairs: DataFrame, weights: Sequence[float] = (1, 1, 5), min_diff: float = 0.05, n: int = 20, key: str = "id", max_delta: float | None = None, max_error: float | None = None) -> DataFrame:
    """Top pairs of each task by a weighted sum of ordinal percentile ranks: small error, small delta, large difference.

    Ordinal ranks count the pairs with worse values, ties by key; pairs over `max_delta` or `max_error` are left out.
    Candidates are written once, by a job of this call.
    """
    rows = pairs.filter(F.col("diff") >= min_diff)
    for c, top in (("delta", max_delta), ("error", max_error)):
        rows = rows if top is None else rows.filter(F.col(c) <= top)
    rows = stored(rows.withColumns({f"_{c}": F.col(c) if c == "diff" else -F.col(c) for c in ("error", "delta", "diff")}))
    sizes = rows.groupBy("task").agg(F.count("*").alias("_size"))
    out = join_same(avg_ranks(rows, {f"_{c}": f"_{c}_mid" for c in ("error", "delta", "diff")}, ["task"]), sizes, ["task"])
    for c in ("error", "delta", "diff"):
        # a tie's rows are told apart by key among themselves: only they share a window
        tie = Window.partitionBy("task", f"_{c}")
        below = F.col(f"_{c}_mid") - (F.count("*").over(tie) + 1) / 2
        place = below + F.row_number().over(tie.orderBy(key)) - 1
        out = out.withColumn(f"{c}_rank", F.when(F.col("_size") == 1, 1.0).otherwise(place / F.nullif(F.col("_size") - 1, F.lit(0))))
    out = out.drop(*[f"_{c}{end}" for c in ("error", "delta", "diff") for end in ("", "_mid")])
    score = (weights[0] * F.col("error_rank") + weights[1] * F.col("delta_rank") + weights[2] * F.col("diff_rank")) / sum(weights)
    w = Window.partitionBy("task").orderBy(F.desc("score"), key)
    return out.drop("_size").withColumn("score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)  # a top-k filter: each task sends n rows of a group at most


def logo_matrix(averaged: DataFrame, locus_id, n_left: int, n_right: int, max_dist: int = 200, key: str = "id", seq: str = "sequence") -> DataFrame:
    """Rows (pos, A, C, G, T) of one locus within `max_dist` of the repeat, with a zero row at 0."""
    one = averaged.filter(F.col(key) == locus_id)
    left = one.select(F.posexplode("left").alias("i", "x"), F.left(seq, F.lit(n_left)).alias("s")).select((F.col("i") - n_left).alias("pos"), "x", F.substring("s", F.col("i") + 1, F.lit(1)).alias("base"))
    right = one.select(F.posexplode("right").alias("i", "x"), F.right(seq, F.lit(n_right)).alias("s")).select((F.col("i") + 1).alias("pos"), "x", F.substring("s", F.col("i") + 1, F.lit(1)).alias("base"))
    gap = one.limit(1).select(F.lit(0).alias("pos"), F.lit(0.0).alias("x"), F.lit("-").alias("base"))
    rows = left.unionByName(right).unionByName(gap).filter(F.abs("pos") <= max_dist)
    return rows.select("pos", *[F.when(F.col("base") == b, F.col("x")).otherwise(0.0).alias(b) for b in "ACGT"])


def in_windows(kmers: DataFrame, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """The rows whose distance lies in one of the inclusive `windows`: a filter that files ordered by distance answer from their statistics."""
    return kmers.filter(reduce(or_, [F.col("distance").between(a, b) for a, b in windows]))


def enrichment_scopes(kmers: DataFrame, by_motif: bool = False, windows: Sequence[tuple[int, int]] = (), whole: bool = True) -> DataFrame:
    """Every occurrence once per scope (all, its motif class) and window (global, inclusive distance ranges).

    Without `whole` there is no global window, and rows outside of all windows are not read where `kmers` comes from `write_kmers`.
    """
    if not whole and not windows:
        raise ValueError("windows are needed where the global one is left out")
    scopes = [F.lit("all")] + ([F.concat(F.lit("motif_"), F.col("motif_class"))] if by_motif else [])
    spans = ([F.lit("global")] if whole else []) + [F.when(F.col("distance").between(a, b), F.lit(f"{a}-{b}")) for a, b in windows]
    rows = kmers if whole else in_windows(kmers, windows)
    out = rows.withColumn("scope", F.explode(F.array(*scopes))).withColumn("window", F.explode(F.array(*spans)))
    return out.filter("window is not null")


def processed_scores(kmers: DataFrame, strata: Sequence[str], use_ranks: bool = True, use_absolute: bool = False) -> DataFrame:
    rows = kmers.withColumn("score", F.abs("ig_score") if use_absolute else F.col("ig_score"))
    return avg_rank(rows, "score", strata, "_r").withColumn("score", F.col("_r")).drop("_r") if use_ranks else rows


#: Places of a stratum up to which a table tells the k-mer of each; beyond it, a search by the k-mers' first places does.
LABELS = 1 << 24
#: A stratum of more rows than the first and fewer than the second (a bound of numpy's draws), with EACH rows or more to a k-mer on average,
#: has its k-mers dealt to the rows without places. Part of the results' definition.
DIRECT, EACH = (1 << 14, 10**9), 64


def stratified_permutation(kmers: DataFrame, n_perm: int, seed: int = 42, use_ranks: bool = True, use_absolute: bool = False, by: Sequence[str] = (), key: str = "obs") -> tuple[DataFrame, DataFrame]:
    """(observed means, null means): per k-mer its mean score, and `null_means`, its mean in each permutation of the scores within every distance.

    In a permutation, the k-mers of a distance take places one after the other, by name, and a bijection gives each score
    a place: a score needs only its number and the k-mers' counts to find its k-mer, so rows never meet. In large strata
    k-mers are dealt to the scores by a faster draw, whose arrangements are equally likely too. Sums by k-mer are
    vectors over permutations. `key` numbers the rows; rows without a k-mer are left out. Processed rows are written once, by a job of this call.
    """
    strata = [*by, "distance"]
    rows = stored(processed_scores(kmers.filter("kmer is not null"), strata, use_ranks, use_absolute).select(*strata, "kmer", F.col("score").cast("double").alias("score"), F.xxhash64(key).alias("_h")))
    observed = rows.groupBy(*by, "kmer").agg(F.avg("score").alias("observed_mean"), F.count("*").alias("n_occurrences"))
    dealt, info = pieces(rows, strata)
    words = rows.groupBy(*strata, "kmer").agg(F.count("*").alias("_count"))
    lists = F.array_sort(F.collect_list(F.struct("kmer", "_count")))  # as many as a distance has different k-mers
    words = words.groupBy(*strata).agg(lists.alias("_words")).select(*strata, F.col("_words.kmer").alias("_kmers"), F.col("_words._count").alias("_counts"))
    info = stored(join_same(info, words, strata, "inner"))

    def shuffle(stratum: tuple, frame: pd.DataFrame, about: pd.Series, perms: range):
        score = frame["score"].to_numpy(np.float64)
        score = score[np.lexsort((score, frame["_h"].to_numpy()))]
        ends = np.cumsum(about["_counts"])
        n = int(about["_n"])
        if DIRECT[0] < n < DIRECT[1] and n >= EACH * len(ends):
            sums = np.stack(list(dealt_sums(seed, stratum, perms, score, about, about["_counts"])), axis=1)
            for word, total in zip(about["_kmers"], sums, strict=True):
                yield {**dict(zip(by, stratum, strict=False)), "kmer": word, "_sums": total}
            return
        label = np.repeat(np.arange(len(ends)), about["_counts"]) if n <= LABELS else None
        sums = np.empty((len(ends), len(perms)))
        places = int(about["_before"]) + np.arange(len(score))
        for i, to in enumerate(permuted_places(seed, stratum, perms, places, n)):
            sums[:, i] = np.bincount(label[to] if label is not None else np.searchsorted(ends, to, "right"), score, len(ends))
        for word, total in zip(about["_kmers"], sums, strict=True):
            yield {**dict(zip(by, stratum, strict=False)), "kmer": word, "_sums": total}

    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*by, "kmer").dtypes)
    each = in_pieces(dealt.select(*strata, "score", "_h", "_piece"), info, strata, n_perm, shuffle, f"{kinds}_vector int, _sums array<double>")
    null = join_same(whole_vectors(each, [*by, "kmer"]), observed.select(*by, "kmer", "n_occurrences"), [*by, "kmer"], "inner")
    return observed, null.select(*by, "kmer", F.transform("_v", lambda s: s / F.col("n_occurrences")).alias("null_means"))


def null_rows(null: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, perm, kmer, null_mean): the vectors of `stratified_permutation` as rows, for results that list them."""
    return null.select(*by, "kmer", F.posexplode("null_means").alias("perm", "null_mean")).select(*by, "perm", "kmer", "null_mean")


def permutation_pvalues(observed: DataFrame, null: DataFrame, min_count: int = 30, use_absolute: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(b + 1) / (m + 1): one-sided for absolute scores, two-sided around the null's mean otherwise. Permutations are counted on their vector."""
    n = F.size("null_means")
    mean = F.aggregate("null_means", F.lit(0.0), lambda s, x: s + x) / n
    rows = join_same(null, observed.filter(F.col("n_occurrences") >= min_count), [*by, "kmer"], "inner").withColumn("null_mean", mean)
    seen, centre = F.col("observed_mean"), F.col("null_mean")
    hits = F.size(F.filter("null_means", lambda x: x >= seen if use_absolute else F.abs(x - centre) >= F.abs(seen - centre)))
    up = F.lit("higher") if use_absolute else F.when(seen > centre, "higher").otherwise("lower")
    return rows.select(*by, "kmer", "n_occurrences", "observed_mean", "null_mean", ((hits + 1) / (n + 1)).alias("p_value"), up.alias("effect_direction"))


def raw_effect(kmers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observed mean score, and the mean of the distances' pool means over a k-mer's occurrences.

    Rows are summed by distance and k-mer before any exchange; pools are made of these sums, so no row meets its pool. Rows
    without a distance or a value of `by` are left out; a missing score counts in no mean, but its occurrence has its pool's.
    """
    strata = [*by, "distance"]
    cells = kmers.dropna(subset=strata).groupBy(*strata, "kmer").agg(F.sum("ig_score").alias("_s"), F.count("ig_score").alias("_c"), F.count("*").alias("_n"))
    pool = Window.partitionBy(*strata)
    cells = cells.withColumn("_pool", F.try_divide(F.sum("_s").over(pool), F.sum("_c").over(pool)))
    seen = F.when(F.col("_pool").isNotNull(), F.col("_n"))
    return cells.groupBy(*by, "kmer").agg(
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("raw_observed"), F.try_divide(F.sum(seen * F.col("_pool")), F.sum(seen)).alias("raw_expected")
    )


def enrichment_run(kmers: DataFrame, by_motif: bool = False, windows: Sequence[tuple[int, int]] = (), n_perm: int = 10_000, seed: int = 42, use_ranks: bool = True, use_absolute: bool = False, min_count: int = 30, key: str = "obs") -> DataFrame:
    """The whole test of k-mers by distance: a row per scope, window and k-mer of `min_count` occurrences or more.

    Scopes are all rows and, with `by_motif`, each motif class; windows are the given ones, or the global one where none is
    given. Scores are ranked and permuted within each distance of a scope and window; raw effects are means of the scores as
    they are. Rows without a k-mer, and a scope's rows without a motif class, are left out; an empty table gives no rows.
    `key` numbers the rows. Runs the jobs of `stratified_permutation`.
    """
    by = ["scope", "window"]
    rows = enrichment_scopes(kmers.filter("kmer is not null and distance is not null"), by_motif, windows, whole=not windows).filter("scope is not null")
    observed, null = stratified_permutation(rows, n_perm, seed, use_ranks, use_absolute, by, key)
    return permutation_pvalues(observed, null, min_count, use_absolute, by).join(raw_effect(rows, by), [*by, "kmer"])


def adjust_pvalues(df: DataFrame, p: str = "p_value", per: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni within each scope; result rows are few (one per k-mer)."""
    rows = df.withColumn("_all", F.lit(1))
    by = [*per, "_all"]
    up = Window.partitionBy(*by).orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(Window.partitionBy(*by))
    out = rows.withColumn("_rk", F.count("*").over(up)).withColumn("_n", n)
    out = out.withColumn("p_adj_fdr_bh", F.least(F.min(F.col(p) * F.col("_n") / F.col("_rk")).over(down), F.lit(1.0)))
    return out.withColumn("p_adj_bonferroni", F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_all", "_rk", "_n")


def dual_significance(df: DataFrame, alpha: float = 0.01, percentile: float = 99.0, per: Sequence[str] = ("scope",)) -> DataFrame:
    """Adds effect size, its percentile rank, and significance by FDR, by effect, and by both. Adjusted rows are written once, by a job of this call."""
    effect = F.col("raw_observed") - F.col("raw_expected")
    adjusted = stored(adjust_pvalues(df, per=per).withColumn("effect_size", effect).withColumn("_size", F.abs(effect)))
    counts = adjusted.groupBy(*per).agg(F.count("*").alias("_n"))
    limits = join_same(counts, exact_quantiles(adjusted, "_size", {"effect_threshold": percentile / 100}, per), per)
    out = join_same(avg_rank(adjusted.drop("_size"), "effect_size", per, "_r"), limits, per).withColumn("effect_percentile", 100 * F.col("_r") / F.col("_n")).drop("_r", "_n")
    out = out.withColumn("sig_fdr", F.col("p_adj_fdr_bh") < alpha).withColumn("sig_effect", F.abs("effect_size") > F.col("effect_threshold"))
    return out.withColumn("sig_dual", F.col("sig_fdr") & F.col("sig_effect"))


def significance_counts(df: DataFrame, alphas: Sequence[float] = (0.05, 0.01, 0.001), per: Sequence[str] = ("scope",)) -> DataFrame:
    """(per, alpha, n, n_fdr, n_bonferroni, n_dual): rows of `dual_significance` below each level by FDR, by Bonferroni, and by FDR with a large effect."""
    level = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    fdr = F.col("p_adj_fdr_bh") < F.col("alpha")
    return df.select(*per, "p_adj_fdr_bh", "p_adj_bonferroni", "sig_effect", level).groupBy(*per, "alpha").agg(
        F.count("*").alias("n"), F.count_if(fdr).alias("n_fdr"), F.count_if(F.col("p_adj_bonferroni") < F.col("alpha")).alias("n_bonferroni"), F.count_if(fdr & F.col("sig_effect")).alias("n_dual")
    )


def effect_histogram(df: DataFrame, bins: int = 50, per: Sequence[str] = ("scope",)) -> DataFrame:
    """(per, bin, lo, hi, n, n_large): effect sizes in equal bins between the least and the largest, the last one closed, and those over the threshold.

    Empty bins have no row; a scope with one value has all of it in bin 0. Missing effects are left out.
    """
    rows = df.filter(present("effect_size"))
    ends = rows.groupBy(*per).agg(F.min("effect_size").alias("_a"), F.max("effect_size").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("effect_size") - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    out = join_same(rows, ends, per).groupBy(*per, at.alias("bin"), "_a", "_b").agg(F.count("*").alias("n"), F.count_if("sig_effect").alias("n_large"))
    return out.select(*per, "bin", (F.col("_a") + F.col("bin") * width).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * width).alias("hi"), "n", "n_large")


def significance_diagnostics(df: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of p-values with the number of significant rows by class, for plots."""
    at = F.least(F.floor(F.col("p_value") * bins), F.lit(bins - 1)).cast("long")
    kind = F.when(F.col("sig_dual"), "dual").when(F.col("sig_fdr"), "fdr").otherwise("none")
    return df.groupBy(at.alias("bin"), kind.alias("kind")).agg(F.count("*").alias("n"), F.max(-F.log10(F.greatest("p_adj_fdr_bh", F.lit(1e-300)))).alias("max_neg_log10"))
