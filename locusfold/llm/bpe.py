"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is the merge result of its bytes exactly when every two neighbours, encoded
together, stay as they are. So the encoding of a prefix is a chain: its last token, and the chain
of the prefix before that. Reading a pretoken byte by byte, the transducer keeps the bytes after
the last settled token, and the chains of all positions that a longer token may still start from.
What those chains share is settled and emitted; the rest is the state, which is bounded by the
longest token. Transitions are computed when first met and remembered.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .pretokens import PretokenMemo

#: Entries of the remembered transitions, which are emptied when full.
STEPS = 3 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}  # proper prefixes: what may still grow
        self.spines: dict[bytes, tuple | None] = {}
        self.memo = PretokenMemo(self.pretoken)
        self.forget()

    def forget(self) -> None:
        """Empties the remembered transitions; state 0 is the start."""
        start = (b"", b"", (), (0,))
        self.states: list[tuple] = [start]
        self.numbers = {start: 0}
        self.steps: dict[int, tuple[int, bytes]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes, trace: list | None = None) -> list[bytes]:
        """Merging in order of rank, for single tokens and the rare compatibility test."""
        parts = [data[i:i + 1] for i in range(len(data))]
        get, none = self.ranks.get, 1 << 60
        while len(parts) > 1:
            found = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if trace is not None:
                trace.append((parts[0], parts[-1]))
        return parts

    def _spine(self, token: bytes) -> tuple | None:
        """What stands at the token's left and right edge while it merges, with the rank that ends each; None if
        the token's bytes do not merge to it in ascending order of rank."""
        trace = [(token[:1], token[-1:])]
        parts = self.merge(token, trace)
        ends = []
        for side in (0, 1):
            parts_ = list(dict.fromkeys(t[side] for t in trace))
            limits = [self.ranks[p] for p in parts_[1:]]
            if limits != sorted(limits):
                return None
            ends.append(list(zip(parts_, [*limits, 1 << 60], strict=True)))
        return tuple(ends) if parts == [token] else None

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether a and b next to each other stay as they are: at no time do the parts at the border merge first."""
        spines = self.spines
        for t in (a, b):
            if t and t not in spines:
                spines[t] = self._spine(t)
        if not spines[b] or (a and not spines[a]):
            return self.merge(a + b) == ([a, b] if a else [b])
        if not a:
            return True
        get = self.ranks.get
        left, right = spines[a][1], spines[b][0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == 1 << 60:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _extend(self, state: tuple, byte: bytes) -> tuple[tuple, bytes]:
        """(next state, ids that are now settled). A state: the settled token before, the bytes pending after it,
        for each pending position the length of its chain's last token, and the live positions, from
        which a longer token may still start."""
        before, pending, lengths, live = state
        pending += byte
        n, found, growing = len(pending), -1, []
        for j in live:
            token = pending[j:]
            if found < 0 and token in self.ranks:
                pair = pending[j - lengths[j - 1]:j] if j else before, token
                fits = self.pairs.get(pair)
                if fits is None:
                    fits = self.pairs[pair] = self.compatible(*pair)
                if fits:
                    found = j
            if token in self.prefixes:
                growing.append(j)
        growing.append(n)
        lengths += (n - found,)
        settled = growing[0]
        if not settled:
            return (before, pending, lengths, tuple(growing)), b""
        used: set[int] = set()
        for j in growing:  # the deepest position that all chains share
            while j != settled and j not in used:
                if j > settled:
                    used.add(j)
                    j -= lengths[j - 1]
                else:
                    used.add(settled)
                    settled -= lengths[settled - 1]
        out, j = [], settled
        while j:
            out.append(self.ranks[pending[j - lengths[j - 1]:j]].to_bytes(4, "little"))
            j -= lengths[j - 1]
        if settled:
            before = pending[settled - lengths[settled - 1]:settled]
            pending = pending[settled:]
        kept = tuple([k if i in used else 0 for i, k in enumerate(lengths[settled:], settled + 1)])
        return (before, pending, kept, tuple([j - settled for j in growing])), b"".join(reversed(out))

    def _learn(self, number: int, byte: int) -> tuple[int, bytes]:
        """The transition of a numbered state by a byte, determinised now."""
        state, ids = self._extend(self.states[number], bytes((byte,)))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        step = self.steps[number << 8 | byte] = (target, ids)
        return step

    def _flush(self, state: tuple) -> bytes:
        _, pending, lengths, _ = state
        out, j = [], len(pending)
        while j:
            out.append(self.ranks[pending[j - lengths[j - 1]:j]].to_bytes(4, "little"))
            j -= lengths[j - 1]
        return b"".join(reversed(out))

    def stream(self, data: Iterable[int]) -> Iterator[bytes]:
        """Ids of one pretoken given byte by byte, as soon as they are settled."""
        if len(self.steps) > STEPS:
            self.forget()
        number, get = 0, self.steps.get
        for byte in data:
            number, ids = get(number << 8 | byte) or self._learn(number, byte)
            if ids:
                yield ids
        yield self._flush(self.states[number])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; short pretokens are remembered for a while."""
        return self.memo.text(text)

    def pretoken(self, word: str) -> bytes:
        return b"".join(self.stream(word.encode()))


class StreamingDecoder:
    """Ids to text in pieces: an incremental UTF-8 machine holds back an unfinished character.

    Bytes that are not UTF-8 become U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.utf8.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


@lru_cache(2)
def transducer(path: str) -> BpeTransducer:
    """One per Python worker, so that what it has learnt serves all tasks of the worker."""
    return BpeTransducer(read_ranks(path))


def encode_documents(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                     block: int = 4096) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, text_back, per row of `docs`.

    `text_back` is decoded from the ids in blocks. A null text counts as empty (no ids, empty text
    back); null and repeated ids are kept; other columns are ignored.
    """

    def run(cols: dict) -> dict:
        bpe = transducer(ranks_path)
        out: dict[str, list] = {"id": cols["id"], "ids": [], "n_tokens": [], "text_back": []}
        for text in cols["text"]:
            ids = bpe.encode(text or "")
            numbers = np.frombuffer(ids, "<u4").tolist()
            decoder = StreamingDecoder(bpe.tokens)
            back = [decoder.feed(numbers[i:i + block]) for i in range(0, len(numbers), block)]
            out["ids"].append(ids)
            out["n_tokens"].append(len(numbers))
            out["text_back"].append("".join(back) + decoder.finish())
        return out

    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        f"id {dict(docs.dtypes)[id_col]}, ids binary, n_tokens long, text_back string", run,
    ).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of `encode_documents`: the ids, and the decoded text's bytes; a row for each row of `docs`.

    A null text counts as empty; null and repeated ids are kept; an empty table gives an empty result.
    """
    return encode_documents(docs, ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text_back").cast("binary"), 256).alias("decoded_sha256"),
    )
