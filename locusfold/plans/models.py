"""Queries of models on the feature vectors of flanks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import ridge, sequence, vectors
from ..operators.staging import stored
from .derive import FLANK, sql
from .genome import _BINS, _EDGES, _IN, _RC, _flanks
from .registry import query, rounded

_PENALTIES = [1e-4, 1e-2, 1.0, 1e2, 1e4]


def _space(spark, k_values):
    motifs = tuple(r.motif for r in sequence.motif_vocab(spark, 2).orderBy("motif").collect())  # at most 4^2 rows
    return vectors.FeatureSpace(tuple(_EDGES), k_values, gc=True, motifs=motifs)


def _loci(spark, sf):
    return _flanks(spark, sf).withColumns({"unit": F.substring("rf", 1, 2), "rev_comp": F.col("str_start") % 2 == 1})


def _mers(k: int) -> str:
    code = " + ".join(f"(strpos('ACGT', substr(w, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))
    return f"SELECT id, {0 if k == 3 else 4 * 64} + grp * {4**k} + {code} AS slot, count(*)::DOUBLE AS v FROM (SELECT id, grp, unnest(list_transform(range(1, greatest(length(bases) - {k - 2}, 1)), lambda i: substr(bases, i, {k}))) AS w FROM g) GROUP BY ALL"


_VECTORS = sql(
    _BINS + f", g AS (SELECT id, CASE side WHEN 'left' THEN 0 ELSE 2 END + bin AS grp, bases FROM b{_IN}), u AS (SELECT id, substr(rf, 1, 2) AS v FROM f{_IN}), "
    f"o AS (SELECT id, CASE WHEN str_start % 2 = 1 THEN {_RC.format('v')} ELSE v END AS w FROM u JOIN tracts USING (id)), "
    f"c AS ({_mers(3)} UNION ALL {_mers(4)} UNION ALL SELECT id, 1280 + grp, length(regexp_replace(bases, '[^GC]', '', 'g')) / length(bases) FROM g WHERE regexp_matches(bases, '[GC]') "
    "UNION ALL SELECT id, 1283 + list_position(['AC', 'AG', 'AT', 'CG', 'CT', 'GT'], least(w, reverse(w))), 1 FROM o WHERE length(w) = 2 AND w[1] <> w[2]) "
    "SELECT id, count(*) AS n_slots, round(sum(v), 6) AS total, round(sum((slot + 1) * v), 4) AS weighted FROM c GROUP BY id", "tracts",
)


def _totals(batches):
    """Of (id, slots, values): the id, the number of slots, the sum of the values and that of their products with slot + 1."""
    for b in batches:
        size = np.diff(b.column(1).offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        slots, values = (b.column(i).flatten().to_numpy() for i in (1, 2))
        sums = [np.bincount(row, v, len(size)) for v in (values, (slots + 1) * values)]
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (size.astype(np.int64), *sums))], ["id", "n_slots", "total", "weighted"])


@query("kmer_vectors", _VECTORS)
def kmer_vectors(spark, sf):
    rows = vectors.flank_vectors(_loci(spark, sf), _space(spark, (3, 4)))
    sums = rows.mapInArrow(_totals, f"id {dict(rows.dtypes)['id']}, n_slots long, total double, weighted double")
    return sums.select("id", "n_slots", F.round("total", 6).alias("total"), F.round("weighted", 4).alias("weighted"))


def ridge_rows(spark, sf):
    """Feature vectors of all loci with two targets and a split by chromosome, written once."""
    near = F.length(F.regexp_replace(F.substring("lf", FLANK - 7, 8), "[^GC]", ""))
    far = F.length(F.regexp_replace("rf", "[^A]", ""))
    part = F.crc32(F.col("chrom").cast("binary")) % 5
    loci = _loci(spark, sf).withColumns({
        "size": near * 0.5 + far * 0.25 + F.col("str_end") - F.col("str_start"), "share": (near + far) / 32.0, "split": F.when(part == 0, "val").when(part == 1, "test").otherwise("train"),
    })
    space = _space(spark, (1, 3))
    return stored(vectors.flank_vectors(loci, space, ["id", "size", "share", "split"])), space


def _fit(spark, sf):
    rows, space = ridge_rows(spark, sf)
    return rows, ridge.fit_ridge(rows, space.width, {"size": "log1p", "share": "arcsine"}, _PENALTIES, features=space.names())


@query("ridge_kmer_search")
def ridge_kmer_search(spark, sf):
    return rounded(_fit(spark, sf)[1].search_frame(spark))


@query("ridge_kmer_coefficients")
def ridge_kmer_coefficients(spark, sf):
    return rounded(_fit(spark, sf)[1].coef_frame(spark))


@query("ridge_kmer_predictions")
def ridge_kmer_predictions(spark, sf):
    rows, fit = _fit(spark, sf)
    return rounded(ridge.predict_vectors(rows.filter("split = 'test'"), fit, ["id", "size", "share"]))
