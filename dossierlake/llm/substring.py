"""Substring deduplication by level-wise doubling.

Words are ``[^\\x20\\x09-\\x0D]+``. Levels are window lengths, each twice the one before, up to ``length``. At a
level only windows whose two halves were both repeated at the level before are candidates; those repeated
survive to the next level. At the last level each candidate is told whether its word sequence also starts
earlier, and words covered by such windows are removed. When no candidate survives, later levels have no rows.
Word sequences are taken as equal at the last level if two independent hashes of theirs, 128 bits together, are.

Texts lie in chunks of a few megabytes in a shared table. Per level a chunk sends each distinct window hash once,
sorted and delta-coded, to the bucket of its hash; the bucket answers with one bit per hash. So a passage that
a third of all documents share costs a bucket one entry per chunk, and no group of documents ever meets in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import BLANK, SECOND_BASE, SECOND_CODE, SECOND_WORD_BASE, SLICE_BYTES, U64, Words, cover, hash_spans, mix, text_slices, window_hash, window_starts
from dossierlake.llm._scratch import Scratch

_LOWEST = np.iinfo(np.int64).min
CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("flags", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("starts", T.BinaryType()), T.StructField("seconds", T.BinaryType())])
REPLY = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])


def _pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the planes of small numbers vanish."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=U64(0)))


def _unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n, U64), dtype=U64)


def _chunks(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, sizes, parts, held, words = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            row = [[chunk], [words], [ids], [np.cumsum([0, *sizes]).tolist()], [pa.compress(b"".join(parts), codec="zstd", asbytes=True) if held else b""]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=CHUNK.names)

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), min(size, SLICE_BYTES)):
                ids += batch.column(0).slice(a, b - a).to_pylist()
                sizes += np.diff(offsets).tolist()
                parts.append(data.tobytes())
                words += len(Words(data, offsets, BLANK).start)
                held += len(data)
                if held >= size:
                    yield out()
                    chunk += 1
                    ids, sizes, parts, held, words = [], [], [], 0, 0
        if ids:
            yield out()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(run, CHUNK)


class _Chunk:
    """A chunk's texts, words and, level by level, the windows that are candidates."""

    def __init__(self, row: pa.Table):
        self.ids = row["ids"][0].values
        self.offsets = np.asarray(row["offsets"][0].values)
        raw = row["packed"][0].as_py()
        self.data = np.frombuffer(pa.decompress(raw, int(self.offsets[-1]), codec="zstd", asbytes=True) if raw else b"", np.uint8)
        self.key = np.asarray(self.ids.fill_null(_LOWEST))  # no id comes before all others
        hashes, counts = [], []
        self.parts = [(a, b, Words(data, offsets, BLANK)) for a, b, data, offsets in text_slices(pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)))]
        for _, _, w in self.parts:
            hashes.append(w.hash)
            counts.append(w.counts)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.held = None  # places of candidates
        self.level = None

    def second(self) -> np.ndarray:
        """A second hash of each candidate, from other hashes of its words."""
        words = [hash_spans(w.data, w.start, w.end, SECOND_CODE, SECOND_BASE) for _, _, w in self.parts]
        return window_hash(np.concatenate(words), self.level, SECOND_WORD_BASE)[self.held] if words else np.zeros(0, U64)

    def start(self, length: int) -> None:
        self.level = length
        self.hash = window_hash(self.words, length)
        self.held = np.flatnonzero(window_starts(self.first, length)[: len(self.hash)])

    def double(self, repeated: np.ndarray) -> None:
        """Windows of twice the length whose halves are both in ``repeated``."""
        half, n = self.level, len(self.hash)
        alive = np.zeros(n, bool)
        alive[repeated] = True
        self.level = 2 * half
        fits = window_starts(self.first, self.level)
        both = alive[: max(0, n - half)] & alive[half:]
        self.held = np.flatnonzero(both & fits[: len(both)])
        self.hash = mix(self.hash[: max(0, n - half)] * U64(3) + mix(self.hash[half:]))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and first word in its text of each candidate."""
        text = np.searchsorted(self.first, self.held, side="right") - 1
        return self.key[text], self.held - self.first[text]


def _filter_view(chunk: _Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shortened hashes, the one of each candidate, and which are there more than once."""
    short = chunk.hash[chunk.held] >> U64(64 - bits)
    found, place, count = np.unique(short, return_inverse=True, return_counts=True)
    return found, place, count > 1


def _runs(h: np.ndarray, second: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by (both hashes, id, start), and which of them is the first of its hashes."""
    order = np.lexsort((starts, ids, second, h))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(second[order]) != 0)
    return order, new


def _last_view(chunk: _Chunk) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Distinct hashes with the earliest window of each, the place of each candidate among them, and those later than the earliest here."""
    (ids, starts), second, h = chunk.places(), chunk.second(), chunk.hash[chunk.held]
    order, new = _runs(h, second, ids, starts)
    head, place = order[new], np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    later = (ids != ids[head][place]) | (starts != starts[head][place])
    return (h[head], ids[head], starts[head], second[head]), place, later


def _send(chunk_id: int, found: np.ndarray, width: int, buckets: int, flags=None, ids=None, starts=None, second=None) -> Iterator[tuple]:
    if not len(found):
        return
    bucket = (found >> U64(width - int(math.log2(buckets)))).astype(np.int64) if buckets > 1 else np.zeros(len(found), np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(found)), strict=True):
        last = (_pack(ids[a:b]), _pack(starts[a:b].astype(np.int32)), second[a:b].tobytes()) if flags is None else (None, None, None)
        yield (int(bucket[a]), chunk_id, int(b - a), _pack_sorted(found[a:b]), None if flags is None else np.packbits(flags[a:b]).tobytes(), *last)


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.StringType(): pa.large_string()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema.fields)
    return pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _replay(chunk: _Chunk, replies: pa.Table, levels: list[int], upto: int, bits: int) -> None:
    """Brings a chunk to ``levels[upto]`` with the answers of the levels before."""
    chunk.start(levels[0])
    for k in range(upto):
        _, place, _ = _filter_view(chunk, bits)
        chunk.double(chunk.held[_answer(replies, levels[k])[place]])


def _answer(replies: pa.Table, level: int) -> np.ndarray:
    """The bits of one level in the order in which the hashes were sent."""
    import pyarrow.compute as pc

    rows = replies.filter(pc.equal(replies["level"], level)).sort_by("bucket")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(rows["bits"].to_pylist(), rows["n"].to_pylist(), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _reply(level: int, last: bool):
    """Answers of one bucket: repeated anywhere, or at the last level, starting earlier elsewhere."""

    def run(sent: pa.Table) -> pa.Table:
        ns = sent["n"].to_pylist()
        h = np.concatenate([_unpack_sorted(x, n) for x, n in zip(sent["hashes"].to_pylist(), ns, strict=True)])
        if last:
            ids = np.concatenate([_unpack(x, n, np.int64) for x, n in zip(sent["ids"].to_pylist(), ns, strict=True)])
            starts = np.concatenate([_unpack(x, n, np.int32) for x, n in zip(sent["starts"].to_pylist(), ns, strict=True)])
            order, new = _runs(h, np.frombuffer(b"".join(sent["seconds"].to_pylist()), U64), ids, starts)
        else:
            order = np.argsort(h, kind="stable")
            new = np.diff(h[order], prepend=~h[order][:1]) != 0
        run_of, answer = np.cumsum(new) - 1, np.empty(len(h), bool)
        if last:
            head = order[new][run_of]
            answer[order] = (ids[order] != ids[head]) | (starts[order] != starts[head])
        else:
            many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(sent["flags"].to_pylist(), ns, strict=True)])
            twice = np.bincount(run_of) > 1
            answer[order] = twice[run_of]
            answer |= many
        out, at = [], 0
        for chunk, bucket, n in zip(sent["chunk"].to_pylist(), sent["bucket"].to_pylist(), ns, strict=True):
            out.append((chunk, level, bucket, n, np.packbits(answer[at : at + n]).tobytes()))
            at += n
        return _table(out, REPLY)

    return run


def _sender(levels: list[int], k: int, bits: int, buckets: int):
    """What a chunk sends at level ``k``, given the answers of the levels before."""

    def send(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table([], SENT)
        chunk, chunk_id = _Chunk(row), row["chunk"][0].as_py()
        _replay(chunk, answers, levels, k, bits)
        if k == len(levels) - 1:
            (found, ids, starts, second), _, _ = _last_view(chunk)
            return _table(list(_send(chunk_id, found, 64, buckets, ids=ids, starts=starts, second=second)), SENT)
        found, _, many = _filter_view(chunk, bits)
        return _table(list(_send(chunk_id, found, bits, buckets, flags=many)), SENT)

    return send


def _one_by_one(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from send(pa.Table.from_batches([batch.slice(i, 1)]), _table([], REPLY)).to_batches()

    return run


def kept_text(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of kept words, joined by one space within a text."""
    data = np.append(words.data, np.uint8(0x20))
    taken = np.zeros(len(data), bool)
    taken[np.flatnonzero(words.inside)] = np.repeat(keep, words.end - words.start)
    held = np.flatnonzero(keep)
    text = np.searchsorted(words.first, held, side="right") - 1
    followed = held[:-1][text[1:] == text[:-1]]  # not the last kept word of its text
    glue = words.end[followed]
    taken[glue], data[glue] = True, 0x20
    total = np.concatenate([[0], np.cumsum(taken)])
    return data[taken], total[words.offsets]


def remove_repeats(docs: DataFrame, length: int = 20, start: int = 5, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20, bucket_words: int = 2_000_000, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col (a whole number, as long; other types are refused), n_words, n_removed, kept.

    ``length`` is the windows' number of words and ``start`` that of the first level; ``length`` is ``start``
    times a power of two. A window goes if its words also start earlier: in a smaller id, or in the same id at an
    earlier word. Windows are judged on the texts as they come in.

    A null id is smaller than any other. Rows that share an id are one document in this order: equal starts tie
    and both stay, so a row that is repeated with its id keeps its words. Null texts have no words, and texts of
    fewer words than a window lose none; ``kept`` is then the words themselves, joined by single spaces. Texts of
    any length are taken whole; empty tables give empty tables; other columns are not read.
    """
    levels = [start]
    while levels[-1] < length:
        levels.append(2 * levels[-1])
    if levels[-1] != length:
        raise ValueError("length is start times a power of two")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} is no whole number, and what starts earlier is told by number")
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    chunks = scratch.keep(_chunks(docs, id_col, text, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / bucket_words))))
    # More bits only where more windows would meet by chance: a false candidate costs work, never a word.
    bits = min(64, max(40, math.ceil(math.log2(max(2, total))) + 12))
    replies = None
    for k, level in enumerate(levels):
        last = k == len(levels) - 1

        send = _sender(levels, k, bits, buckets)
        sent = chunks.mapInArrow(_one_by_one(send), SENT) if replies is None else chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, SENT)
        answered = scratch.keep(sent.groupBy("bucket").applyInArrow(_reply(level, last), REPLY), f"level{level}")
        replies = answered if replies is None else replies.unionByName(answered)

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def finish(row: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(row)
        _replay(chunk, answers, levels, len(levels) - 1, bits)
        _, place, later = _last_view(chunk)
        earlier = later | _answer(answers, length)[place]
        gone = cover(chunk.held[earlier], length, len(chunk.words))
        texts, at = [], 0
        for _, _, words in chunk.parts:
            n = len(words.start)
            data, offsets = kept_text(words, ~gone[at : at + n])
            texts.append(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)))
            at += n
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.first])
        kept = pa.chunked_array(texts, pa.large_string()).combine_chunks() if texts else pa.array([], pa.large_string())
        return pa.table([chunk.ids, pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), kept.cast(pa.string())], names=schema.names)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)


def op2_substring(spark, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that are left without windows of 20 words that start earlier too."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, j, array_to_string(ws[j:j + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS j FROM d)),
f AS (SELECT doc_id, j FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, j) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS p FROM f),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
