"""Descriptive statistics and annotation tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import avg_rank, exact_quantiles, join_same, present


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of a chi-square with an even or odd number of degrees, by the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def correlation_pvalue(df: DataFrame, r: str = "r", n: str = "n", out: str = "p") -> DataFrame:
    """`df` with the two-sided p-value of a correlation; null below three rows or without r."""

    @F.udf("double")
    def tail(r: float | None, n: int | None) -> float | None:
        if r is None or n is None or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return df.withColumn(out, tail(F.col(r), F.col(n).cast("long")))  # aggregate rows only


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; null where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def histogram_proportion(df: DataFrame, value: str, group: str, bins: int = 60) -> DataFrame:
    """Equal-width bins over the pooled range, each group's shares adding up to 1."""
    rows = df.filter(present(value))
    span = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    counts = rows.crossJoin(F.broadcast(span)).groupBy(group, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row joins
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def quantile_summary(df: DataFrame, value: str, probs: Sequence[float] = (0.5, 0.95, 0.99), per: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(present(value))
    ends = rows.groupBy(*per).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    names = {f"p{round(p * 100)}": p for p in probs}
    return join_same(ends, exact_quantiles(rows, value, names, per), per).select(*per, "n", "lo", *names, "hi")


def label_correlations(df: DataFrame, x: str, y: str, per: str) -> DataFrame:
    rows = df.filter(present(x, y))
    ranked = avg_rank(avg_rank(rows, x, [per], "_rx"), y, [per], "_ry")
    return ranked.groupBy(per).agg(
        F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("pearson"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman")
    )


def density_2d(df: DataFrame, x: str, y: str, bins: int = 50, margin: float = 0.05, per: str | None = None) -> DataFrame:
    """Counts on a square grid over the shared range of both columns, widened by a margin, of each group of `per` on a range of its own."""
    rows = df.filter(present(x, y))
    by = [per] if per else []
    span = rows.groupBy(*by).agg(F.least(F.min(x), F.min(y)).cast("double").alias("a"), F.greatest(F.max(x), F.max(y)).cast("double").alias("b"))
    span = span.select(*by, (F.col("a") - margin * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + margin * (F.col("b") - F.col("a"))).alias("hi"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    return join_same(rows, span, by, "inner").groupBy(*by, cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count("*").alias("n"))


def residuals(df: DataFrame, pred: str, true: str) -> DataFrame:
    rows = df.select((F.col(pred) - F.col(true)).alias("r")).filter(present("r"))
    r = F.col("r")
    out = rows.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("lo"), F.max(r).alias("hi"))
    return join_same(out, exact_quantiles(rows, "r", {"median": 0.5}), ()).select("n", "mean", "std", "lo", "median", "hi")


def box_stats(df: DataFrame, value: str, category: str) -> DataFrame:
    """n, quartiles and whiskers (the extreme values within 1.5 IQR) by category."""
    rows = df.filter(present(value))
    q = rows.groupBy(category).agg(F.count("*").alias("n"))
    q = join_same(q, exact_quantiles(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [category]), [category])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = join_same(rows, q.select(category, low.alias("_lo"), high.alias("_hi")), [category]).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
    ends = inside.groupBy(category).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi"))
    return join_same(q, ends, [category]).orderBy("median", category)


def kruskal_wallis(df: DataFrame, value: str, category: str) -> DataFrame:
    """One row: tie-corrected H, groups, rows, epsilon squared and eta squared, and p. Rows with a missing value are left out."""
    rows = df.filter(present(value) & F.col(category).isNotNull()).select(category, F.col(value).cast("double").alias(value))
    groups = avg_rank(rows, value).groupBy(category).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").cast("double").alias("n"), F.count("*").alias("k"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = sums.crossJoin(F.broadcast(ties)).select(h.alias("H"), "k", n.cast("long").alias("n"))  # one row each

    @F.udf("double")
    def tail(h: float | None, k: int) -> float | None:
        return None if h is None or k < 2 else chi2_tail(h, k - 1)

    n = F.col("n")
    return out.select("H", "k", "n", (F.col("H") / (n - 1)).alias("epsilon_sq"), ((F.col("H") - F.col("k") + 1) / (n - F.col("k"))).alias("eta_sq"), tail("H", "k").alias("p"))


def effect_size_table(df: DataFrame, values: Sequence[str], categories: Sequence[str]) -> DataFrame:
    out = None
    for v in values:
        for c in categories:
            one = kruskal_wallis(df, v, c).select(F.lit(v).alias("label"), F.lit(c).alias("category"), "H", "k", "n", "epsilon_sq", "eta_sq", "p")
            out = one if out is None else out.unionByName(one)
    return out


def pca_projection(df: DataFrame, vec: str, key: str, k: int = 2, fit_filter: str | None = None) -> DataFrame:
    """First k principal components of centred vectors; each component's largest loading is positive.

    Centre and components come from the rows of `fit_filter` (all by default); all rows are projected.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = F.expr(fit_filter) if fit_filter else F.lit(True)
    rows = df.filter(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"), known.alias("_fit"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows.filter("_fit")).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred.filter("_fit"))
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    p = vector_to_array("_p")
    return model.transform(centred).select(key, *[(p[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])
