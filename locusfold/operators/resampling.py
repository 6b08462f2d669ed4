"""Bootstraps and permutations of groups of any size, in pieces of rows and blocks of replicates.

A group is cut into pieces by a hash of its rows' order and its size alone. What a piece draws follows from counters
keyed by the seed, the group and the replicate, so results depend neither on partitioning nor on where a piece is
computed. A piece returns sums by replicate as vectors, which are added element by element after one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_same, present
from .staging import stored

#: Rows of a piece, and replicates of a vector. Both are part of the results' definition: change them and other draws are made.
PIECE_ROWS, WIDTH = 1 << 20, 512
#: Rows that are worked on at once within a piece, so that they stay in the cache.
NEAR = 1 << 14
#: Rows of a block, which a number of 16 bits tells apart: larger pieces are drawn block by block. Part of the results' definition too.
BLOCK = 1 << 16


def pieces(rows: DataFrame, per: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with _piece; a row per piece with its _size, its number _at, the rows before it, its group's _n and the _sizes of all its pieces).

    `rows` has _h, a hash that orders the rows of a group. Groups have as many pieces as their size asks for; rows of equal
    hash stay in one piece. `rows` is read three times.
    """
    sizes = rows.groupBy(*per).agg(F.ceil(F.count("*") / PIECE_ROWS).alias("_parts"))
    dealt = join_same(rows, sizes, per, "inner").withColumn("_piece", F.pmod(F.col("_h"), F.col("_parts")).cast("int")).drop("_parts")
    counts = dealt.groupBy(*per, "_piece").agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*per)
    before = F.sum("_size").over(group.orderBy("_piece")) - F.col("_size")
    at = F.row_number().over(group.orderBy("_piece")) - 1
    every = F.array_sort(F.collect_list(F.struct("_piece", "_size")).over(group))["_size"]  # one for every PIECE_ROWS rows
    return dealt, counts.select(*per, "_piece", "_size", at.alias("_at"), before.alias("_before"), F.sum("_size").over(group).alias("_n"), every.alias("_sizes"))


def in_pieces(dealt: DataFrame, info: DataFrame, per: Sequence[str], n: int, fn: Callable[[tuple, pd.DataFrame, pd.Series, range], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of `fn(group's key, a piece's rows, its row of info, the replicates of a vector)` for all pieces and vectors of n replicates.

    Few pieces are dealt out several times, to share their vectors among tasks; which of the tasks has a vector does not show in the result.
    """
    vectors = -(-n // WIDTH)
    count = info.count()
    lots = max(1, min(vectors, 256 // max(count, 1)))
    columns = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(key: tuple, rows: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(about):
            for v in range(int(key[-1]), vectors, lots):
                out += [{"_vector": v, **r} for r in fn(key[:-2], rows, about.iloc[0], range(v * WIDTH, min(n, (v + 1) * WIDTH)))]
        return pd.DataFrame(out, columns=columns)

    lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot")
    left, right = (df.select("*", lot).groupBy(*per, "_piece", "_lot") for df in (dealt, info))
    return left.cogroup(right).applyInPandas(run, schema)


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, vector): vectors of doubles added element by element within equal keys, one vector held at a time."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, held = None, None, []

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in held], schema.field(i).type) for i in range(len(keys))]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array([v for _, v in held], pa.list_(pa.float64()))], [*keys, vector])
            held.clear()
            return batch

        schema = None
        for b in batches:
            schema = b.schema
            lists = b.column(len(keys))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(zip(*(b.column(j).to_pylist() for j in range(len(keys))), strict=True)):
                part = flat[ends[i]:ends[i + 1]]
                if k == key:
                    total += part
                else:
                    if key is not None:
                        held.append((key, total))
                    key, total = k, part.copy()
            if len(held) > 1000:
                yield flush(schema)
        if key is not None:
            held.append((key, total))
            yield flush(schema)

    return df.select(*keys, vector).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, `{vector}` array<double>")


def whole_vectors(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _v): the sums over pieces, all replicates of a key in one array."""
    vectors = F.array_sort(F.collect_list(F.struct("_vector", "_sums")))  # as many numbers as replicates
    return sum_vectors(each, [*keys, "_vector"], "_sums").groupBy(*keys).agg(vectors.alias("_v")).withColumn("_v", F.flatten("_v._sums"))


def drawn_size(n: int, frac: float) -> int:
    """Rows of a resample: a share of the group, at least ten or all."""
    return max(min(n, 10), int(np.floor(n * frac)))


def times(seed: int, about: pd.Series, replicate: int, drawn: int) -> np.ndarray:
    """How often a replicate of `drawn` rows of the group takes each row of a piece, with replacement.

    The replicate is first split among the pieces, by a multinomial draw that all pieces repeat alike, then within each; in
    pieces of over BLOCK rows it is split among blocks in the same way, whose draws are numbers of 16 bits that stay in the cache.
    Groups of equal size and order are drawn alike.
    """
    key = np.array([seed, replicate], np.uint64)
    size = int(about["_size"])
    if len(about["_sizes"]) > 1:
        split = np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, 0, 1], np.uint64)))
        drawn = split.multinomial(drawn, np.asarray(about["_sizes"]) / int(about["_n"]))[int(about["_at"])]
    if size <= BLOCK:
        raw = np.random.Philox(key=key, counter=np.array([0, 0, int(about["_piece"]), 0], np.uint64)).random_raw(int(drawn))
        return np.bincount(_scaled(raw, size), minlength=size)
    bits = np.random.SFC64([seed, replicate, int(about["_piece"])])
    starts = np.arange(0, size, BLOCK)
    sizes = np.minimum(size - starts, BLOCK)
    out = np.empty(size, np.int32)
    for at, n, k in zip(starts.tolist(), sizes.tolist(), np.random.Generator(bits).multinomial(int(drawn), sizes / size).tolist(), strict=True):
        taken = bits.random_raw(-(-k // 4)).view(np.uint16)[:k] if n == 1 << 16 else _scaled(bits.random_raw(k), n)
        out[at:at + n] = np.bincount(taken, minlength=n)
    return out


def _scaled(raw: np.ndarray, n: int) -> np.ndarray:
    """Numbers of 64 random bits as numbers below n."""
    return ((raw >> np.uint64(11)) * 2.0**-53 * n).astype(np.intp)


def with_interval(df: DataFrame, values: Column, per: Sequence[str], level: float) -> DataFrame:
    """(per, lo, hi, n_boot): the percentile interval, with linear interpolation, of an array; NaN and null are left out."""
    known = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = df.select(*per, known.alias("_s")).withColumn("n_boot", F.size("_s").cast("long"))

    def at(p: float) -> Column:
        place = F.lit(p) * (F.col("n_boot") - 1)
        low, high = (F.get("_s", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (place - F.floor(place)) * (high - low)

    return rows.select(*per, at((1 - level) / 2).alias("lo"), at((1 + level) / 2).alias("hi"), "n_boot")


def bootstrap_interval(df: DataFrame, value: str, order: str, n_boot: int, seed: int, per: Sequence[str], level: float) -> DataFrame:
    """(per, lo, hi, n_boot): percentile interval of the mean of a value over resamples of each group's rows.

    Rows without the value are left out. Pieces return a sum per replicate, so the exchange is bounded by pieces times
    replicates. The rows are written once, by a job of this call.
    """
    rows = stored(df.filter(present(value)).select(*per, F.xxhash64(order).alias("_h"), F.col(value).cast("double").alias("_x")))
    dealt, info = pieces(rows, per)

    def sums(group: tuple, frame: pd.DataFrame, about: pd.Series, replicates: range) -> Iterator[dict]:
        x = frame["_x"].to_numpy(np.float64)
        x = x[np.lexsort((x, frame["_h"].to_numpy()))]
        n = int(about["_n"])
        yield {**dict(zip(per, group, strict=True)), "_sums": np.array([times(seed, about, r, n) @ x / n for r in replicates])}

    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*per).dtypes)
    each = in_pieces(dealt, stored(info), per, n_boot, sums, f"{kinds}_vector int, _sums array<double>")
    return with_interval(whole_vectors(each, per), F.col("_v"), per, level)


def stream(seed: int, group: tuple, at: int, count: int) -> np.ndarray:
    """`count` raw numbers of 64 bits from place `at`, a multiple of 4, of the stream of a group."""
    name = int.from_bytes(hashlib.blake2b("\x1f".join("" if x is None or x != x else str(x) for x in group).encode(), digest_size=8).digest(), "little")
    bits = np.random.Philox(key=np.array([seed, name], np.uint64))
    bits.advance(at // 4)
    return bits.random_raw(count)


def permuted_places(seed: int, group: tuple, replicates: range, places: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each replicate, where a random permutation of 0..n-1 puts these places: nothing is sorted and no other place is needed.

    A Feistel network over pairs (l, r) with l < a, r < b and a b >= n: halves are shifted in turn by random functions of
    the other half, eight times or, for small n, more often. Results of n or more, fewer than a in all, go through it again.
    """
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = max(1, -(-n // a))
    rounds = 4 + 96 // (n + 1)  # of two shifts
    need = -(-rounds * (a + b) // 4) * 4
    size = len(places)
    left, right = (x.astype(np.intp) for x in np.divmod(places, b))
    chunk = max(1, min((1 << 14) // max(size, 1), (1 << 16) // need))  # few places: several replicates at once
    for first in range(replicates.start, replicates.stop, chunk):
        m = min(chunk, replicates.stop - first)
        bits = stream(seed, group, first * need, need * m).reshape(m, need) >> np.uint64(33)
        up = (bits[:, :rounds * b] * np.uint64(a) >> np.uint64(31)).astype(np.intp).reshape(m, rounds, b)
        down = (bits[:, rounds * b:rounds * (a + b)] * np.uint64(b) >> np.uint64(31)).astype(np.intp).reshape(m, rounds, a)
        of = np.repeat(np.arange(m), size) if m > 1 else np.zeros(1, np.intp)
        step = size * m if m > 1 else NEAR  # one replicate of many places: parts that stay in the cache
        out = np.concatenate([_network(np.tile(left[i:i + step], m), np.tile(right[i:i + step], m), of, up, down, a, b) for i in range(0, max(size, 1), step)])
        if a * b > n:
            while len(far := np.flatnonzero(out >= n)):
                out[far] = _network(*np.divmod(out[far], b), of[far] if m > 1 else of, up, down, a, b)
        yield from out.reshape(m, size)


def dealt_sums(seed: int, group: tuple, replicates: range, score: np.ndarray, about: pd.Series, counts: np.ndarray) -> Iterator[np.ndarray]:
    """For each replicate, the sums of a piece's scores by label where a random permutation deals labels, `counts` of each, to the group's rows.

    How many of each label a piece gets follows a multivariate hypergeometric draw that all pieces repeat alike. Within it, rows
    draw labels independently, by shares; then as many rows as a label has too many, chosen at random, take the missing labels
    in random order. No step tells rows apart, so all arrangements of these counts are equally likely.
    """
    name = int.from_bytes(hashlib.blake2b("\x1f".join("" if x is None or x != x else str(x) for x in group).encode(), digest_size=8).digest(), "little")
    at, sizes, m, k = int(about["_at"]), [int(x) for x in about["_sizes"]], len(score), len(counts)
    for r in replicates:
        wanted = left = np.asarray(counts, np.int64)
        if len(sizes) > 1:
            split = np.random.Generator(np.random.SFC64([seed, name, r]))
            for size in sizes[:at + 1]:
                wanted = split.multivariate_hypergeometric(left, size, method="marginals")
                left = left - wanted
        bits = np.random.SFC64([seed, name, r, at, 1])
        rng = np.random.Generator(bits)
        shares = np.diff(np.round(np.cumsum(wanted) * (65536 / m)).astype(np.int64), prepend=0)
        table = np.repeat(np.arange(k, dtype=np.uint8 if k <= 256 else np.uint16), shares)
        label = np.take(table, bits.random_raw(-(-m // 4)).view(np.uint16)[:m], mode="clip")
        have, sums = np.zeros(k, np.int64), np.zeros(k)
        for i in range(0, m, NEAR):
            part = label[i:i + NEAR].astype(np.intp)
            have += np.bincount(part, minlength=k)
            sums += np.bincount(part, score[i:i + NEAR], k)
        over, lack = np.maximum(have - wanted, 0), np.maximum(wanted - have, 0)
        if over.any():
            moved, new = _surplus(rng, label, have, over), np.repeat(np.arange(k), lack)
            rng.shuffle(new)
            x = score[moved]
            sums += np.bincount(new, x, k) - np.bincount(label[moved], x, k)
        yield sums


def _surplus(rng: np.random.Generator, label: np.ndarray, have: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Places of `over` rows of each label, chosen at random: the first ones of a random sequence of places, or else of all rows with the label."""
    out, ends = [], np.cumsum(have)
    order = np.argsort(label, kind="stable") if len(have) > 64 else None
    if order is None:
        tried = rng.integers(0, len(label), min(len(label), int(2 * (over * (len(label) / np.maximum(have, 1))).max()) + 64))
        nth, first = np.arange(len(tried)), np.empty(len(label), np.intp)
        first[tried[::-1]] = nth[::-1]
        tried = tried[first[tried] == nth]
        kinds = label[tried]
    for x in np.flatnonzero(over):
        found = tried[kinds == x] if order is None else ()
        if len(found) < over[x]:
            found = rng.choice(np.flatnonzero(label == x) if order is None else order[ends[x] - have[x]:ends[x]], over[x], replace=False)
        out.append(found[:over[x]])
    return np.concatenate(out)


def _network(l: np.ndarray, r: np.ndarray, of: np.ndarray, up: np.ndarray, down: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places of pairs after all shifts by the tables of their replicates `of`; the pairs are overwritten. Sums stay below twice
    their bound, so the smaller of x and x - bound, as unsigned numbers, is x modulo the bound."""
    spare = np.empty_like(l)
    m, rounds, _ = up.shape
    at_b, at_a = of * b, of * a
    for k in range(rounds):
        for x, bound, table, y, at in ((l, a, up, r, at_b), (r, b, down, l, at_a)):
            np.take(table[:, k].ravel(), y if m == 1 else y + at, out=spare, mode="clip")
            x += spare
            np.subtract(x, bound, out=spare)
            np.minimum(x.view(np.uintp), spare.view(np.uintp), out=x.view(np.uintp))
    l *= b
    l += r
    return l
