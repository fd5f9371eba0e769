"""Benchmark decontamination by winnowing.

Words are hashed; a k-gram's hash is that of k consecutive words. Of every run of ``window - k + 1`` consecutive
k-grams the smallest hash is kept, the last of equals. Two texts that share ``window`` words share such a run, so
they share the fingerprint kept of it. Fingerprints of documents and items are joined, and each hit is extended:
every window of ``window`` words around it is compared whole with the items' windows. A benchmark of bounded size is
joined within the tasks that read the documents; of a larger one a filter of fixed size goes there, and the windows
around what passes are joined with the items' windows by a shuffle.

An item of fewer words than a window is one window of its own length; for these lengths the k-gram is the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import LOWER, NOT_ALNUM, Words, cover, text_slices, window_hash, window_starts
from dossierlake.llm._scratch import Scratch
from dossierlake.llm._sieve import passing, sieve


def winnow(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest of each ``run`` consecutive hashes, the last of equals; texts' ends ignored."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for d in range(1, run):
        smaller = grams[d : d + n] <= best
        best[smaller] = grams[d : d + n][smaller]
        at[smaller] = np.flatnonzero(smaller) + d
    return np.unique(at)


class Items:
    """Windows and fingerprints of benchmark items."""

    def __init__(self, ids: list, texts: pa.Array, window: int, k: int):
        self.ids, self.window, self.k = ids, window, k
        self.prints: dict[int, np.ndarray] = {}  # by window length
        self.hashes: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # bounds in the list of items of each window
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for a, _, data, offsets in text_slices(texts):
            words = Words(data, offsets, NOT_ALNUM, LOWER)
            for i, n in enumerate(words.counts):
                if not n:
                    continue
                h = words.hash[words.first[i] : words.first[i + 1]]
                length = min(int(n), window)
                w = window_hash(h, length)
                found.setdefault(length, []).append((w, np.full(len(w), a + i)))
                if length == window:
                    grams = window_hash(h, k)
                    prints.setdefault(length, []).append(grams[winnow(grams, window - k + 1)])
        for length, parts in found.items():
            h, item = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            pairs = np.unique(np.stack([h, item.astype(h.dtype)], 1), axis=0)
            self.hashes[length], first = np.unique(pairs[:, 0], return_index=True)
            self.owners[length] = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
            self.prints[length] = np.unique(np.concatenate(prints[length])) if length == window else self.hashes[length]

    def hits(self, words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of ``length`` words of the texts that are windows of items: their first words and places in ``hashes``."""
        starts, full = around(words, length, self.window, self.k, lambda h: np.flatnonzero(is_in(h, self.prints[length])))
        own = is_in(full, self.hashes[length])
        return starts[own], np.searchsorted(self.hashes[length], full[own])


def around(words: Words, length: int, window: int, k: int, passing: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``length`` words around a fingerprint that ``passing`` finds."""
    full = window_hash(words.hash, length)
    if length == window:
        run = length - k + 1
        grams = window_hash(words.hash, k)
        kept = winnow(grams, run)  # a run over a text's end only adds fingerprints
        kept = kept[passing(grams[kept])]
        starts = np.unique((kept[:, None] - np.arange(run)).ravel())
        starts = starts[(starts >= 0) & (starts < len(full))]
    else:
        starts = passing(full)
    starts = starts[window_starts(words.first, length)[starts]]
    return starts, full[starts]


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(id, text) of the items that have a text, equal ones once."""
    return items.select(items[item_id].cast("string").alias("id"), items[item_text].alias("text")).where(F.col("text").isNotNull()).distinct()


def _block(items: DataFrame, window: int, k: int, most: int):
    """The broadcast items, or None if their texts have more than ``most`` bytes."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    if size > most:
        return None
    rows = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Items(rows["id"].to_pylist(), rows["text"].combine_chunks(), window, k))  # of checked size


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 7, share: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit, items, contaminated.

    ``items`` are the ids of items with occurring windows, as ordered distinct strings. A document is contaminated
    if ``n_hit > 0 and share * n_hit >= n_words``.

    The benchmark is measured first. Up to ``block_bytes`` of it is sent to the executors with its fingerprints; a
    larger one is joined by shuffles, after one pass over the documents that leaves the windows that may be hits.

    Null texts have no words; null items have no windows; windows of an item without an id are hits, but it isn't
    among ``items``; items that share an id are one name there; repeated documents are rows of their own; empty
    tables give no hits or no rows; other columns are not read.
    """
    items = _items(items, item_id, item_text)
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    block = _block(items, window, k, block_bytes)
    if block is None:
        scratch = scratch or Scratch(docs.sparkSession, "decontam")
        return _by_join(source, items, window, k, share, scratch).drop("row").withColumnRenamed("id", id_col)
    schema = T.StructType([docs.schema[id_col], *_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, found, bad = _judge(batch.column(1), block.value, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(bad, pa.bool_())], names=schema.names)

    return source.mapInArrow(run, schema)


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]


def _judge(texts: pa.Array, items: Items, share: int) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Of each text: words, words hit, items found, and whether it is contaminated."""
    n_words, n_hit, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for _, _, data, offsets in text_slices(texts):
        words = Words(data, offsets, NOT_ALNUM, LOWER)
        hit = np.zeros(int(words.first[-1]), bool)
        found: list[set] = [set() for _ in words.counts]
        for length in items.hashes:
            starts, place = items.hits(words, length)
            if not len(starts):
                continue
            hit |= cover(starts, length, len(hit))
            bounds, owner = items.owners[length]
            text_of = np.searchsorted(words.first, starts, side="right") - 1
            for t, p in np.unique(np.stack([text_of, place], 1), axis=0):
                found[t].update(owner[bounds[p] : bounds[p + 1]].tolist())
        n_words.append(words.counts)
        n_hit.append(np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first]))
        named += [sorted({items.ids[j] for j in x} - {None}) for x in found]
    n_words, n_hit = np.concatenate(n_words), np.concatenate(n_hit)
    return n_words, n_hit, named, (n_hit > 0) & (share * n_hit >= n_words)


#: Copies of an item's window, among which the windows of documents are dealt, as one window may be in most documents.
SALT = 16


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(length, window, id, print) of all items: their windows, and apart from these their fingerprints."""
    schema = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("id", T.StringType()), T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Items(batch.column(0).to_pylist(), batch.column(1), window, k)
            for length, h in own.hashes.items():
                bounds, owner = own.owners[length]
                hashes = np.repeat(h, np.diff(bounds)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), length, np.int32)), pa.array(hashes), pa.array([own.ids[j] for j in owner], pa.string()), pa.nulls(len(hashes), pa.int64())], names=schema.names)
                prints = own.prints[length].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), length, np.int32)), pa.nulls(len(prints), pa.int64()), pa.nulls(len(prints), pa.string()), pa.array(prints)], names=schema.names)

    return items.mapInArrow(run, schema)


def _by_join(source: DataFrame, items: DataFrame, window: int, k: int, share: int, scratch: Scratch) -> DataFrame:
    """(row, id, n_words, n_hit, items, contaminated) of ``source``, (id, text) and maybe more columns, which stay too."""
    spark = source.sparkSession
    table = scratch.keep(_item_windows(items, window, k), "items")
    lengths = [r[0] for r in table.select("length").distinct().collect()]  # at most ``window`` of them
    filters = spark.sparkContext.broadcast({n: sieve(table.where((F.col("length") == n) & F.col("print").isNotNull()), "print") for n in lengths})  # of fixed size
    rows = scratch.keep(source.withColumn("row", F.monotonically_increasing_id()), "documents")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("window", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words, row = Words(data, offsets, NOT_ALNUM, LOWER), np.asarray(batch.column(0))
                blank = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row[a:b]), pa.array(words.counts, pa.int64()), pa.nulls(b - a, pa.int32()), blank, blank], names=schema.names)
                for length in lengths:
                    starts, full = around(words, length, window, k, lambda h, n=length: passing(filters.value[n], h))
                    own = np.searchsorted(words.first, starts, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(row[a + own]), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), length, np.int32)), pa.array(starts - words.first[own]), pa.array(full.view(np.int64))], names=schema.names)

    scanned = scratch.keep(rows.select("row", "text").mapInArrow(run, schema), "scanned")
    named = table.where(F.col("window").isNotNull()).groupBy("length", "window").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = scanned.where(F.col("window").isNotNull()).withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(named, ["length", "window", "salt"])
    merged = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    none = F.lit(0).cast("long")
    covered = F.aggregate("spans", F.struct(none.alias("n"), none.alias("upto")), lambda s, x: F.struct((s["n"] + F.greatest(none, x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")))["n"]
    merged = merged.select("row", covered.alias("n_hit"), "items")
    counted = scanned.where(F.col("n_words").isNotNull()).select("row", "n_words").join(merged, "row", "left")
    counted = counted.select("row", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return rows.select("row", "id").join(counted, "row").select("row", "id", "n_words", "n_hit", "items", bad.alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 7, share: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, whatever their names; see ``contamination``."""
    items = _items(items, item_id, item_text)
    block = _block(items, window, k, block_bytes)
    if block is None:
        # The caller's columns travel as one, so that none can clash.
        scratch = scratch or Scratch(docs.sparkSession, "decontam")
        kept = scratch.keep(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("place")), "own")
        found = _by_join(kept.select(F.col("place").alias("id"), F.col("own").getField(text).alias("text")), items, window, k, share, scratch)
        return kept.join(found.where("NOT contaminated").select(F.col("id").alias("place")), "place").select("own.*")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_judge(batch.column(place), block.value, share)[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontam(spark, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that lie in windows of ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWERED = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWERED.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_LOWERED.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[j:j + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, j, array_to_string(ws[j:j + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, item_id, dw.n, j FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""
