"""Best-fit packing by a length histogram.

The documents are tokenised and cut into pieces in one pass. Only the histogram of piece
lengths (at most `capacity` rows) reaches the driver; best fit runs over its counts, never over
documents, and yields slot ranges by (length, rank). Documents then take their slots by their
rank within their length. Ranks are counted within (length, salt) and shifted by a prefix sum
of the counts, so a length that a third of all rows share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .pretokens import PretokenMemo


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PretokenEncoder:
    """Encodes texts with a `tokenizers` file as its plain call does; every distinct pretoken is encoded once, by the
    file's BPE model, and remembered.

    A text that holds an added token (such as <|endoftext|>) is encoded as a whole, without the memory.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.visible = self.tokenizer.model, _visible_bytes()
        self.memo = PretokenMemo(self._pretoken)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(self._packed(self.tokenizer.encode(t, add_special_tokens=False).ids))
            else:
                out.append(self.memo.text(t))
        return out

    def _pretoken(self, word: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.visible))])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack_ids(f"<{len(ids)}I", *ids)


@lru_cache(2)
def pretoken_encoder(path: str) -> PretokenEncoder:
    """One per Python worker, so that its memory serves all tasks of the worker."""
    return PretokenEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` tokens: id, piece, start, length, ids_crc32[, ids].

    A document's ids end in `separator`. Only documents of more than `capacity` ids are cut; the
    first piece takes the remainder, the others are full. A null text counts as empty (one
    separator). Null and repeated ids are kept, a row each; other columns are ignored.
    """
    tail = np.array([separator], "<u4").tobytes()

    def cut(cols: dict) -> dict:
        encoder = pretoken_encoder(tokenizer_path)
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, ids in zip(cols["id"], encoder.encode([t or "" for t in cols["text"]]), strict=True):
            ids += tail
            n = len(ids) // 4
            ends = [*range(n % capacity or min(n, capacity), n, capacity), n]
            for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                part = ids[4 * a:4 * b]
                for key, v in zip(out, (doc, k, a, b - a, zlib.crc32(part), part if with_ids else None), strict=True):
                    out[key].append(v)
        return out

    kind = dict(docs.dtypes)[id_col]
    pieces = map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary", cut,
    ).withColumnRenamed("id", id_col)
    return pieces if with_ids else pieces.drop("ids")


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slot ranges (length, first rank, count, first sequence, offset) of best fit decreasing.

    Sequences with the same room left are interchangeable and are filled as a group: the items of
    a length go to the group with the least room that fits, as many to each sequence as it takes.
    A length makes at most two new groups, so the plan's size depends on `capacity` alone.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not groups.get(room):
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            for layer in range(each if full else 0):
                plan.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= each * full
            put(room - each * length, first, full)
            if full < count and left:  # fewer than a sequence takes
                for layer in range(left):
                    plan.append((length, rank, 1, first + full, capacity - room + layer * length))
                    rank += 1
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, count - full)
    return plan


def pack(pieces: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length",
         capacity: int = 2048, salts: int = 64, salt_rows: int = 1 << 14) -> DataFrame:
    """`pieces` with sequence_id and offset: every sequence is gapless from 0 and within `capacity`.

    Lengths must lie in 1..capacity. `keys` order the rows of a length; rows with equal keys
    (also null ones) are kept, each with a slot of its own. Columns of any other name are passed on,
    but for sequence_id and offset, which are written anew. An empty table stays empty. Ranks of a
    length are counted in `salts` parts, or in more where these would have over `salt_rows` rows.
    """
    passed = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialize(pieces.select(F.struct(*passed).alias("row"), F.col(length_col).cast("int").alias("len")))
    histogram = {r[0]: r[1] for r in rows.groupBy("len").count().collect()}  # at most `capacity` rows
    if any(n is None or not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    parts = rows.sparkSession.createDataFrame([(n, max(salts, -(-rows_of // salt_rows))) for n, rows_of in histogram.items()], "len int, parts long")
    salt = F.pmod(F.xxhash64(*[F.col("row")[k] for k in keys]), F.col("parts")).alias("salt")
    rows = rows.join(F.broadcast(parts), "len").select("row", "len", salt)  # a row for each length
    counts = materialize(rows.groupBy("len", "salt").count())
    plan = sorted(plan_best_fit(histogram, capacity))
    table = np.array(plan or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    place = table[:, 0] * (1 << 46) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(place, length.to_numpy(np.int64) * (1 << 46) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy(np.int64) - table[at, 1], "offset": table[at, 4]})

    before = counts.select("len", "salt", (F.sum("count").over(Window.partitionBy("len").orderBy("salt")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("len", "salt").orderBy(*[F.col("row")[k] for k in keys]))
    ranked = rows.withColumn("within", within).join(before, ["len", "salt"]).select("row", slot(F.col("len"), F.col("within") - 1 + F.col("before")).alias("slot"))
    return ranked.select("row.*", "slot.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack `docs` (doc_id, text): the rows of `token_pieces` with their slots."""
    return pack(token_pieces(docs, tokenizer_path, capacity=capacity), capacity=capacity)
