"""Runs of words: maximal stretches that repeat with a period, found by a suffix automaton with link-cut access.

Appending word i to the automaton makes the path from its state to the root carry last occurrence i. Before that,
the path falls into segments of equal last occurrence j, each ending at a deepest state of size L, which is the
longest suffix shared by the prefixes that end at i and at j. If i - j <= L, a square of period i - j ends at i, and
the stretch with this period starts at j - L + 1. A longer period that is a multiple of the smallest never shows:
all its strings occurred later already. Link-cut trees keep the segments, so that a word costs O(log n) amortised.

Texts lie in their rows, so nothing is shuffled; memory is that of one text's automaton, and only the stretches of a
text in which word groups occur again need one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, small_batches

#: Words are what ASCII white space leaves, as in bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
_MIX = 0x9E3779B97F4A7C15


def squares(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """(start, smallest period) -> last word of each maximal stretch of at least two periods."""
    moves, link, size = [{}, {}], [0, 0], [0, 0]  # state 1 is the empty string, 0 is none
    left, right, above, seen = [0, 0], [0, 0], [0, 0], [-1, -1]  # splay trees of path segments; `seen` holds at their roots

    def rotate(x: int) -> None:
        p = above[x]
        g = above[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            above[b] = p
        above[p], above[x], seen[x] = x, g, seen[p]
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(x: int) -> None:
        while p := above[x]:
            first = left[p] == x
            if not first and right[p] != x:
                return
            g = above[p]
            if g:
                if left[g] == p:
                    rotate(p if first else x)
                elif right[g] == p:
                    rotate(x if first else p)
            rotate(x)

    def state(ways: dict[int, int], to: int, n: int, last: int) -> int:
        moves.append(ways)
        link.append(to)
        size.append(n)
        left.append(0)
        right.append(0)
        above.append(to)
        seen.append(last)
        return len(link) - 1

    found: dict[tuple[int, int], int] = {}
    tip = 1
    for i, w in enumerate(words):
        new = state({}, 1, size[tip] + 1, -1)
        p, tip = tip, new
        while p and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p:
            q = moves[p][w]
            if size[p] + 1 < size[q]:  # the class of q divides; both parts keep the last occurrence
                c = state(moves[q].copy(), link[q], size[p] + 1, -1)
                splay(q)
                above[c], seen[c], left[c], right[c] = above[q], seen[q], left[q], q
                if left[q]:
                    above[left[q]] = c
                left[q], above[q] = 0, c
                link[q] = c
                while p and moves[p].get(w) == q:
                    moves[p][w] = c
                    p = link[p]
                q = c
            link[new] = above[new] = q
        x, below = new, 0
        while x:
            splay(x)
            j = seen[x]
            if j >= 0 and i - j <= size[x]:
                found[j - size[x] + 1, i - j] = i
            if right[x]:
                seen[right[x]] = j
            right[x] = below
            below, x = x, above[x]
        seen[below] = i
        splay(new)
    return found


def _repeated(words: np.ndarray, group: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of words covered by groups that occur at least twice (by hash: never too few)."""
    n = len(words) - group + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(group):
        key = (key ^ words[k:k + n].astype(np.uint64)) * np.uint64(_MIX)
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    at = np.flatnonzero(np.isin(key, again))
    edge = np.zeros(len(words) + 2, np.int32)
    np.add.at(edge, at + 1, 1)
    np.add.at(edge, at + group + 1, -1)
    step = np.diff(np.cumsum(edge) > 0)
    ends = np.flatnonzero(step)
    return list(zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True))


def find_runs(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and two periods, by start, then period.

    A run's words lie in groups of least / 2 words that occur twice within the run; other words are not read again.
    """
    group = max(1, (least + 1) // 2)
    out, open_ = [], [(0, words)]
    while open_:
        at, part = open_.pop()
        pieces = [(a, b) for a, b in _repeated(part, group) if b - a >= max(least, 2)]
        if pieces == [(0, len(part))]:
            out += [(at + s, e - s + 1, q) for (s, q), e in squares(part.tolist()).items() if e - s + 1 >= least]
        else:
            open_ += [(at + a, part[a:b]) for a, b in pieces]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs array<struct<start, length, period>> and `collapsed`: the text's words, joined by single spaces,
    without those that any run contains after its first period.

    A null or empty text has no words and an empty `collapsed`; keys may be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, offsets, runs, kept = [], [0], [], []
            for t in batch.column(1).to_pylist():
                words = (t or b"").split()
                codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
                found = find_runs(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), least)
                if found:
                    drop = np.zeros(len(words), bool)
                    for s, n, q in found:
                        drop[s + q:s + n] = True
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()]))
                else:
                    kept.append(b" ".join(words))
                sizes.append(len(words))
                runs += found
                offsets.append(len(runs))
            cols = list(zip(*runs, strict=True)) or [[], [], []]
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(kept, pa.binary()).cast(pa.string())],
                [key, "n_words", "runs", "collapsed"],
            )

    schema = f"`{key}` {docs.select(key).dtypes[0][1]}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def echoed(text: Column, doc_id: Column) -> Column:
    """The text whose tail repeats, for ids whose checksum ends in 0: from word a on, the first p words again and again."""
    h = crc32_of_id(doc_id)
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rest = (n - a).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p), F.ceil(rest / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), rest))).otherwise(text)


def run_report(docs: DataFrame, least: int = 12) -> DataFrame:
    """Runs of each text after `echoed`: their number, the longest one, and digests of all runs and of the collapsed text.

    Cases as in `collapse_runs`; a null id repeats nothing.
    """
    found = collapse_runs(docs.select("doc_id", echoed(F.col("text"), F.col("doc_id")).alias("text")), least)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
