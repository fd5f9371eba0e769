"""Best-fit packing by sum of squares.

A document goes where the sum over all residual gaps of the squared number of open sequences with that gap becomes
smallest, a new sequence being one of the choices. Documents are taken in falling length. Pieces are dealt to
shards by a hash of their row, each of about ``shard_pieces`` pieces at any input size, and every shard packs its
own sequences: a shard leaves a few sequences partly filled, and shards grow in number, not in size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import BLANK, LOWER, U64, Words, hash_spans, text_slices
from dossierlake.llm._bpe import LONGEST, merges
from dossierlake.llm._scratch import Scratch
from dossierlake.llm._tokenizer import load

#: Encoded units that a process remembers; beyond it, those used in the fewest slices are forgotten.
REMEMBERED = 500_000
#: Bytes of text that are cut into units at once, but for a longer text, and units that are encoded at once.
ENCODED_BYTES, AT_ONCE = 4 << 20, 1 << 20
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
#: What the tokenizer's pattern takes ASCII bytes for. An apostrophe may begin a contraction, so it is odd.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _ODD


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is encoded by itself: the bytes with simple words in lower case, start, end and whether simple, and the first unit of each text.

    Words are cut at ASCII white space. The tokenizer drops white space, no match of its pattern crosses any, and
    its normalisers work on single characters or on marks that join letters, so a text's ids are its words' ids
    in a row. A simple word has nothing but ASCII and Latin-1 letters, digits and marks, and is cut as the pattern
    does: runs of letters, single digits, runs of marks. A word with anything else, with an apostrophe or with the
    beginning of a special token is one unit as it stands.
    """
    words, n = Words(data, offsets, BLANK), len(data)
    kind, low = _KIND[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    latin = ((tail & 0xC0) == 0x80) & (tail != 0x97) & (tail != 0xB7)
    kind[lead[latin]] = kind[lead[latin] + 1] = _LETTER
    low[lead[latin & (tail < 0x9F)] + 1] += 0x20
    kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = _ODD
    odd = np.zeros(len(words.start), bool)
    odd[np.searchsorted(words.start, np.flatnonzero((kind == _ODD) & words.inside), side="right") - 1] = True
    opens = np.zeros(n, bool)
    opens[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & words.inside[1:]
    if odd.any():
        size = (words.end - words.start)[odd]
        there = np.repeat(words.start[odd] - np.cumsum(size) + size, size) + np.arange(size.sum())
        opens[there], low[there] = False, data[there]
    opens[words.start] = True
    start = np.flatnonzero(opens)
    first = np.append(np.searchsorted(start, words.start), len(start))  # unit of each word
    end = np.append(start[1:], n)
    end[first[1:] - 1] = words.end
    return low, start, end, np.repeat(~odd, np.diff(first)), first[words.first]


def _same(a: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether each two spans hold the same bytes."""
    size = np.where(size_a == size_b, size_a, 0)
    before = np.cumsum(size) - size
    inner = np.arange(size.sum())
    wrong = a[np.repeat(start_a - before, size) + inner] != b[np.repeat(start_b - before, size) + inner]
    out = size_a == size_b
    out[np.searchsorted(before, np.flatnonzero(wrong), side="right") - 1] = False
    return out


class _Encoded:
    """Ids of the units that a process has met, found by hash and compared by their bytes."""

    def __init__(self, tokenizer: str):
        self.tokenizer, self.merges = load(tokenizer), merges(tokenizer)
        self.hash, self.used = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, "<u4"), np.zeros(0, np.uint8)
        self.place = np.zeros((4, 0), np.int64)  # of each unit: start and number of its ids, and of its bytes

    def _library(self, unit: bytes) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, "<u4")

    def _learn(self, raw: list[bytes], simple: np.ndarray) -> list[np.ndarray]:
        """Ids of units: short simple ones are merged many at once, the rest by the library."""
        short = [i for i, (x, plain) in enumerate(zip(raw, simple.tolist(), strict=True)) if plain and len(x) <= LONGEST]
        out = [None] * len(raw)
        for i, ids in zip(short, self.merges.encode([raw[i] for i in short]), strict=True):
            out[i] = ids.astype("<u4")
        return [self._library(x) if ids is None else ids for x, ids in zip(raw, out, strict=True)]

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and how many each unit has."""
        found, at, which = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        size = end - start
        # Units of one hash and other bytes stand for themselves and aren't remembered.
        other = np.flatnonzero(~_same(data, start, size, data, start[at][which], size[at][which]))
        which[other] = len(found) + np.arange(len(other))
        at = np.append(at, other)
        start, size, simple = start[at], size[at], simple[at]
        k = np.minimum(np.searchsorted(self.hash, found), max(0, len(self.hash) - 1))
        met, known = np.zeros(len(at), bool), np.zeros(len(at), bool)
        if len(self.hash):
            met[: len(found)] = self.hash[k] == found
            held, own = k[met[: len(found)]], np.flatnonzero(met)
            known[own] = _same(data, start[own], size[own], self.raw, *self.place[2:, held])
        own, new = np.flatnonzero(known), np.flatnonzero(~known)
        raw = [data[a : a + n].tobytes() for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)]
        learned = self._learn(raw, simple[new])
        count = np.array([len(x) for x in learned], np.int64)
        table = np.concatenate([self.ids, *learned]) if learned else self.ids
        begin, number = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[own], number[own] = self.place[:2, k[own]]
        begin[new], number[new] = len(self.ids) + np.cumsum(count) - count, count
        self.used[k[own]] += 1
        fresh = ~met[new] & (new < len(found))
        self._remember(found[new[fresh]], [x for x, f in zip(learned, fresh, strict=True) if f], [x for x, f in zip(raw, fresh, strict=True) if f])
        number = number[which]
        return table[np.repeat(begin[which] - np.cumsum(number) + number, number) + np.arange(number.sum())], number

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the first id of each text and their number."""
        low, start, end, simple, first = units(data, offsets)
        parts, counts = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for a in range(0, len(start), AT_ONCE):
            own = slice(a, a + AT_ONCE)
            ids, count = self.encode(low, start[own], end[own], simple[own])
            parts.append(ids)
            counts.append(count)
        return np.concatenate(parts), np.cumsum(np.concatenate(counts))[first]

    def _remember(self, found: np.ndarray, ids: list[np.ndarray], raw: list[bytes]) -> None:
        if len(self.hash) + len(found) > REMEMBERED:
            self._forget(REMEMBERED // 2)
        place = np.zeros((4, len(found)), np.int64)
        place[1], place[3] = [len(x) for x in ids], [len(x) for x in raw]
        place[0], place[2] = len(self.ids) + np.cumsum(place[1]) - place[1], len(self.raw) + np.cumsum(place[3]) - place[3]
        self.ids = np.concatenate([self.ids, *ids])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), np.uint8)])
        every = np.concatenate([self.hash, found])
        order = np.argsort(every, kind="stable")
        self.hash, self.used = every[order], np.append(self.used, np.ones(len(found), np.int64))[order]
        self.place = np.concatenate([self.place, place], 1)[:, order]

    def _forget(self, keep: int) -> None:
        """Keeps the ``keep`` units that most slices had."""
        held = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        place = self.place[:, held].copy()
        for row, flat in ((0, "ids"), (2, "raw")):
            n = place[row + 1]
            at = np.cumsum(n) - n
            setattr(self, flat, getattr(self, flat)[np.repeat(place[row] - at, n) + np.arange(n.sum())])
            place[row] = at
        self.hash, self.used, self.place = self.hash[held], self.used[held] // 2, place


_process: dict[str, _Encoded] = {}


def encode_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: row_key, id_col, piece, start, length, ids_crc32; row_key tells rows with one id apart."""
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _process.get(tokenizer)
        if ids_of is None:
            ids_of = _process[tokenizer] = _Encoded(tokenizer)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for a, b, data, offsets in text_slices(batch.column(1), ENCODED_BYTES):
                ids, first = ids_of.texts(data, offsets)
                for i, (lo, hi) in enumerate(pairwise(first.tolist())):
                    whole = ids[lo:hi].tobytes() + end
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        rows.append(a + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            keys = np.asarray(rows, np.int64) + key
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(docs[id_col], docs[text]).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item; items in falling length, ties in their order, each at most ``capacity`` long."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # What the sum of squares gains if a sequence of gap g takes the item; gap 0 is closed and isn't counted.
        there = count[s:capacity]
        gap, best = -1, (2 * int(count[capacity - s]) + 1) if s < capacity else 0
        if there.any():
            gain = 2 * count[: capacity - s] - 2 * there + 2
            gain[0] = 1 - 2 * there[0]
            gain[there == 0] = np.iinfo(np.int64).max
            k = int(np.argmin(gain))
            if gain[k] <= best:
                gap = s + k
        if gap < 0:
            at, gap = made, capacity
            made += 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > s:
            open_at[gap - s].append(at)
            count[gap - s] += 1
    return sequence, offset


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text: str = "text", shard_pieces: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``; one longer than ``capacity`` is cut into full pieces and a rest.
    A null or empty text is the end id alone. Null, tied and repeated ids are documents of their own; an empty
    table gives an empty table; other columns are not read. Texts of any length are encoded whole.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(encode_pieces(docs, capacity, tokenizer, end_id, id_col, text), "pieces")  # encoded once
    shards = max(1, -(-pieces.count() // shard_pieces))
    schema = T.StructType([pieces.schema[c] for c in (id_col, "piece", "start", "length", "ids_crc32")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "piece"], kind="stable")
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)[schema.names]

    return pieces.withColumn("shard", F.pmod(F.xxhash64("row_key", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(pack_shard, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
