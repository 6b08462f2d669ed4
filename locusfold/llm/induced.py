"""Induced suffix sorting of one shard with common-prefix values, on disk-backed queues.

Suffixes are sorted by inducing: from the sorted left-most-S suffixes the L-type ones follow in
ascending order of their first character, and from those all S-type ones in descending order.
The queue between the two is a radix priority queue: one lane for each first character, first in,
first out, whose lanes go to files beyond a bound. It carries (position, common prefix with the
one before); a lane is handled in waves, one wave for each repeat of its character. The
left-most-S substrings are sorted by the same induction and named, and the string of names is
sorted in turn; only orders up to DEPTH bytes matter here, so that last recursion is by doubling.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Common prefixes are counted up to here; longer ones are not told apart.
DEPTH = 64
_LANES = 258
_MASKS = np.array([0xFFFF << (16 * i) for i in range(4)], np.uint64)


class LaneQueue:
    """Chunks of (position, common prefix) by lane, first in, first out.

    Up to `bound` entries are held in memory. Beyond it the lanes that hold much are appended to
    their files, so that a lane is its file and then what it holds.
    """

    #: Entries that queues of this process have written to disk.
    written = 0
    _serial = itertools.count()

    def __init__(self, folder: str, bound: int):
        self.name, self.bound, self.held = os.path.join(folder, f"queue-{next(self._serial)}"), bound, 0
        self.lanes: list[list] = [[] for _ in range(_LANES)]
        self.sizes = [0] * _LANES
        self.stored: list[list[int]] = [[] for _ in range(_LANES)]  # where the chunks of the lane's file start

    def push(self, lane: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.lanes[lane].append((positions, prefixes))
        self.sizes[lane] += len(positions)
        self.held += len(positions)
        if self.held > self.bound:
            for k in sorted(range(_LANES), key=self.sizes.__getitem__, reverse=True):
                if self.held <= self.bound // 2:
                    break
                self._store(k)

    def _store(self, lane: int) -> None:
        with open(f"{self.name}-{lane}", "ab") as f:
            for positions, prefixes in _together(self.lanes[lane]):
                self.stored[lane].append(f.tell())
                np.save(f, positions)
                np.save(f, prefixes)
        LaneQueue.written += self.sizes[lane]
        self.held -= self.sizes[lane]
        self.lanes[lane], self.sizes[lane] = [], 0

    def pop(self, lane: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The lane's chunks, or from the last to the first; what is pushed to it from now on comes by another pop."""
        chunks, places = self.lanes[lane], self.stored[lane]
        self.held -= self.sizes[lane]
        self.lanes[lane], self.sizes[lane], self.stored[lane] = [], 0, []
        if backwards:
            yield from reversed(chunks)
        if places:
            path = f"{self.name}-{lane}-read"
            os.replace(f"{self.name}-{lane}", path)
            with open(path, "rb") as f:
                for at in reversed(places) if backwards else places:
                    f.seek(at)
                    yield np.load(f), np.load(f)
            os.unlink(path)
        if not backwards:
            yield from chunks


class _Inducer:
    """One direction of induction over `text`; `wanted` marks the positions that it may place."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: LaneQueue):
        self.text, self.wanted, self.queue = text, wanted, queue
        self.since = np.zeros(_LANES, np.uint8)  # least common prefix since the last push to a lane
        self.seen = np.zeros(_LANES, bool)

    def feed(self, lane: int, positions: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Places the predecessors of sources given in order; those of the same lane are returned, as part of the next wave."""
        before = positions - 1
        ok = (before >= 0) & self.wanted[before]
        at = np.flatnonzero(ok)
        low, again = np.minimum(self.since, prefixes.min()), None
        if len(at):
            targets = self.text[before[at]]
            order = np.argsort(targets, kind="stable")
            at, targets = at[order], targets[order]
            edges = np.flatnonzero(np.r_[True, targets[1:] != targets[:-1], True])
            padded = np.append(prefixes, np.uint8(255))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lane_at, t = at[a:b], int(targets[a])
                cuts = np.concatenate(([0], lane_at + 1))
                least = np.minimum.reduceat(padded, cuts)
                found = least[:-1]
                found[0] = min(found[0], self.since[t])
                found = np.minimum(found, DEPTH - 1) + np.uint8(1)
                if not self.seen[t]:
                    self.seen[t], found[0] = True, 0
                low[t] = least[-1]
                if t == lane:
                    again = (before[lane_at], found)
                else:
                    self.queue.push(t, before[lane_at], found)
        self.since = low
        return again

    def waves(self, lane: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The lane's entries in order, chunk by chunk; what they place in their own lane comes after them."""
        wave = self.queue.pop(lane)
        while wave:
            again = []
            for chunk in _together(wave):
                yield chunk
                if (more := self.feed(lane, *chunk)) is not None:
                    again.append(more)
            wave = again


def _together(chunks: Iterable[tuple[np.ndarray, np.ndarray]], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small chunks joined, in order."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for c in chunks:
        held.append(c)
        n += len(c[0])
        if n >= size:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _runs(text: np.ndarray) -> np.ndarray:
    """Repeats of the character from each position on, up to DEPTH."""
    ends = _run_ends(text)
    left = np.repeat(ends, np.diff(ends, prepend=-1))
    left -= np.arange(len(text), dtype=np.int32)
    return np.minimum(left + 1, DEPTH).astype(np.uint8)


def _run_ends(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(text[1:] != text[:-1], True)).astype(np.int32)


def _is_s(text: np.ndarray) -> np.ndarray:
    """S-type positions: the suffix is smaller than the one after it; the last is S."""
    ends = _run_ends(text)
    rises = np.append(text[1:] > text[:-1], True)
    return np.repeat(rises[ends], np.diff(ends, prepend=-1))


def _induce(text: np.ndarray, is_s: np.ndarray, run: np.ndarray, order: np.ndarray, prefix: np.ndarray, folder: str,
            bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, given the left-most-S ones in ascending order:
    (positions, common prefix with the larger neighbour) chunk by chunk, never across a first character."""
    firsts = text[order]
    bounds = np.searchsorted(firsts, np.arange(_LANES + 1))
    queue, placed = LaneQueue(folder, bound), LaneQueue(folder, bound)
    up = _Inducer(text, ~is_s, queue)
    for c in range(_LANES):
        last = None
        for wave in up.waves(c):
            placed.push(c, *wave)
            last = int(wave[0][-1])
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            p = prefix[a:b].copy()
            p[0] = 0 if last is None else min(run[last], run[order[a]])
            up.feed(c, order[a:b], p)
    queue = LaneQueue(folder, bound)
    down = _Inducer(text, is_s, queue)
    for c in range(_LANES - 1, -1, -1):
        last = None
        for wave in down.waves(c):
            yield wave
            last = int(wave[0][-1])
        if c == 0 and last is None:
            yield np.array([len(text) - 1], np.int32), np.zeros(1, np.uint8)  # the end of the text
        carried = None  # of the L-type ones the prefix is with the smaller neighbour: shift by one
        for positions, p in placed.pop(c, backwards=True):
            positions, p = positions[::-1], p[::-1]
            if carried is None:
                head = 0 if last is None else min(run[last], run[positions[0]])
            else:
                head = carried
            shifted = np.concatenate((np.array([head], np.uint8), p[:-1]))
            carried = p[-1]
            yield positions, shifted
            down.feed(c, positions, shifted)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to DEPTH."""
    n = len(text)
    padded = np.concatenate((text, np.arange(2 * DEPTH, dtype=text.dtype)))
    words = np.ndarray((len(padded) - 3,), "<u8", buffer=padded, strides=(2,))  # four characters at once
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, DEPTH, 4):
        differ = words[a[live] + k] ^ words[b[live] + k]
        ends = differ != 0
        at = live[ends]
        out[at] = k + (differ[ends][:, None] & _MASKS != 0).argmax(1)
        live = live[~ends]
        if not len(live):
            break
        out[live] = k + 4
    return np.minimum(out, n - np.maximum(a, b)).astype(np.uint8)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each left-most-S substring (up to DEPTH bytes), for `lms` in text order."""
    length = np.append(np.diff(lms) + 1, 1)
    at = np.searchsorted(lms, ordered)
    size = length[at]
    a, b = ordered[:-1], ordered[1:]
    same = (size[:-1] == size[1:]) & (_common(text, a, b) >= np.minimum(size[:-1], DEPTH))
    name = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(lms), np.int64)
    out[at] = name
    return out


def sorted_suffixes(data: np.ndarray, folder: str | None = None, bound: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of `data` (uint16: 1 for a separator, byte + 2) in descending order of their first DEPTH
    characters: (positions, common prefix with the one before, up to DEPTH), never across a first character."""
    text = np.append(data, np.uint16(0))
    is_s, run = _is_s(text), _runs(text)
    lms = np.flatnonzero(is_s & np.append(False, ~is_s[:-1])).astype(np.int32)
    with tempfile.TemporaryDirectory(dir=folder) as temp:
        if len(lms) > 1:
            start = lms[np.argsort(text[lms], kind="stable")]
            mark = np.zeros(len(text), bool)
            mark[lms] = True
            found = [p[mark[p]] for p, _ in _induce(text, is_s, run, start, np.zeros(len(start), np.uint8), temp, bound)]
            rank = _names(text, lms, np.concatenate(found)[::-1])
            step, order = 1, np.argsort(rank, kind="stable")
            while step * 2 <= DEPTH and rank[order[-1]] + 1 < len(rank):
                pair = rank * (len(rank) + 1) + np.append(rank[step:], np.full(min(step, len(rank)), -1))[:len(rank)] + 1
                order = np.argsort(pair, kind="stable")
                fresh = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
                rank = np.empty_like(rank)
                rank[order] = fresh
                step *= 2
            start = lms[order]
            prefix = np.append(np.uint8(0), _common(text, start[:-1], start[1:]))
        else:
            start, prefix = lms, np.zeros(len(lms), np.uint8)
        yield from _induce(text, is_s, run, start, prefix, temp, bound)
