"""Near-duplicate classes by BagMinHash.

A text is the bag of its runs of five words, each with its count. Every unit of weight of every shingle runs a
Poisson process of rate one whose points fall on random slots of the signature; a slot keeps the earliest time. Two
signatures agree in a slot with the probability of the bags' weighted Jaccard similarity. Units are not walked one
by one: levels of weight are halved into blocks [1, 2), [2, 4), [4, 8) ..., a block is one process of the rate of its
width whose points also draw a level and count only below the shingle's weight, and a process is followed only while
its time is below the text's latest slot.

Signatures are cut into bands. In each band the member that shares most bands with others is the hub; all members are
compared with it by exact overlap of their bags, and links join into components. What is left are bands whose members
are still in several components. Of these every pair across components is compared too: pairs of small bands as rows,
those of large bands as products of blocks of members, a block pair a group, which hands back one link for a member
and another component. So no link between different bags that share a band is lost, no band is ever expanded into rows
of all its pairs, and no group holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import LOWER, NOT_ALNUM, U64, Words, mix, text_slices, window_hash, window_starts
from dossierlake.llm._columns import join_groups, spare
from dossierlake.llm._scratch import Scratch

SHINGLE, BANDS, ROWS = 5, 32, 4
SLOTS = BANDS * ROWS
_UNIT = 2.0**-53


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle. A text of fewer words is one shingle, and so is a text without any."""
    h = window_hash(words.hash, size)
    start = np.flatnonzero(window_starts(words.first, size)[: len(h)])
    text = np.searchsorted(words.first, start, side="right") - 1
    short = np.flatnonzero(words.counts < size)
    some = np.zeros(len(short), U64)
    for k in range(size - 1):
        there = words.counts[short] > k
        some[there] = mix(some[there] + words.hash[words.first[short[there]] + k])
    return np.concatenate([text, short]), np.concatenate([h[start], mix(some + U64(1))])


def bags(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle of each text."""
    _, at, count = np.unique(mix(h + mix(text.astype(U64))), return_index=True, return_counts=True)
    return text[at], h[at], count


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The earliest time of each slot of each of n texts."""
    sig = np.full(n * slots, np.inf)
    block = np.ceil(np.log2(count + 1e-9)).astype(np.int64).clip(0) + 1  # number of blocks below the count
    unit = np.repeat(np.arange(len(h)), block)
    k = np.arange(block.sum()) - np.repeat(np.cumsum(block) - block, block)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    width = np.maximum(low, 1)
    seed = mix(h[unit] + mix(k.astype(U64) + U64(77)))
    owner, weight, time, step = text[unit], count[unit], np.zeros(len(unit)), 0
    while len(seed):
        points = max(1, step)
        i = np.arange(step + 1, step + points + 1, dtype=U64)
        a = mix(seed[:, None] + i * U64(0x9E3779B97F4A7C15))
        b = mix(a + U64(0xD1B54A32D192ED03))
        gap = -np.log(((a >> U64(11)).astype(float) + 0.5) * _UNIT) / width[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        slot = (b % U64(slots)).astype(np.int64) + owner[:, None] * slots
        level = low[:, None] + ((b >> U64(32)) % width[:, None].astype(U64)).astype(np.int64)
        counted = level < weight[:, None]
        np.minimum.at(sig, slot[counted], at[counted])
        step += points
        latest = sig.reshape(n, slots).max(1)
        live = at[:, -1] < latest[owner]
        seed, owner, weight, time, low, width = seed[live], owner[live], weight[live], at[live, -1], low[live], width[live]
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sig.view(U64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(mix(np.arange(bands, dtype=U64) + U64(5)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def bag_names(text: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """Sixteen bytes a text that are equal for equal bags."""
    out = np.zeros((n, 2), U64)
    for k, salt in enumerate((11, 13)):
        np.add.at(out[:, k], text, mix(h + mix(np.full(1, salt, U64))))
    raw = out.tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(n)]


def _read(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_slices(texts):
        yield (b - a, *shingles(Words(data, offsets, NOT_ALNUM, LOWER)))


def _sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("bag", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys = [], [], []
            for n, t, h in _read(batch.column(1)):
                names += bag_names(t, h, n)
                sizes.append(np.bincount(t, minlength=n))
                keys.append(band_keys(signatures(*bags(t, h), n)).ravel())
            keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), lists], names=schema.names)

    return docs.select(docs[id_col], docs[text]).mapInArrow(run, schema)


def with_bag(docs: DataFrame, text: str, bag: str) -> DataFrame:
    """``docs`` with the name of each text's bag in column ``bag``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(bag, T.BinaryType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for n, t, h in _read(batch.column(place)) for x in bag_names(t, h, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def overlaps(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Intersection and union of the two bags of each row."""
    both = []
    for column in (left, right):
        parts, base = [], 0
        for n, t, h in _read(column):
            parts.append((t + base, h))
            base += n
        t, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64))
        key, at, count = np.unique(mix(h + mix(t.astype(U64))), return_index=True, return_counts=True)
        both.append((key, t[at], count))
    (ka, ta, ca), (kb, tb, cb) = both
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    n = len(left)
    inter = np.bincount(ta[i], np.minimum(ca[i], cb[j]), n).astype(np.int64)
    total = (np.bincount(ta, ca, n) + np.bincount(tb, cb, n)).astype(np.int64)
    return inter, total - inter


class _Links:
    """Verified links between bags and the components they make."""

    def __init__(self, scratch: Scratch, texts: DataFrame, threshold: tuple[int, int]):
        self.scratch, self.texts, self.threshold, self.round = scratch, texts, threshold, 0
        self.links: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        """Adds those of the distinct ``pairs`` (a, b) that are similar enough."""
        self.round += 1
        above, below = self.threshold
        left = pairs.join(self.texts.select(F.col("bag").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(self.texts.select(F.col("bag").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    inter, union = overlaps(part.column(2), part.column(3))
                    yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(below * inter >= above * union))

        schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
        batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark = self.scratch.spark
        before = spark.conf.get(batch_rows)
        spark.conf.set(batch_rows, "512")  # rows here hold two texts
        try:
            found = self.scratch.keep(both.mapInArrow(run, schema), f"links{self.round}")
        finally:
            spark.conf.set(batch_rows, before)
        self.links = found if self.links is None else self.links.unionByName(found)

    def components(self) -> DataFrame:
        """(bag, component) of all bags with links; a component is named by its smallest bag."""
        return components(self.scratch, self.links, f"components{self.round}")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """Connected components by alternating large and small stars until nothing changes."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark, k = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, k = now, k + 1
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, f"{name}-{k}")
        scratch.discard(f"{name}-{k - 1}")
    return edges.select(F.col("u").alias("bag"), F.col("v").alias("component"))


def _compatible(threshold: tuple[int, int], a: str, b: str):
    above, below = threshold
    return below * F.least(a, b) >= above * F.greatest(a, b)


def _small_bands(rest: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs across components of bands of a few members."""
    other = rest.select("band", F.col("bag").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"))
    pairs = rest.join(other, "band").where((F.col("bag") > F.col("b")) & (F.col("component") != F.col("component_b")) & _compatible(threshold, "n", "n_b"))
    return pairs.select(F.col("bag").alias("a"), "b")


def _features(texts: DataFrame) -> DataFrame:
    """Each bag's shingles, numbered where they repeat, as 64-bit hashes."""
    schema = T.StructType([T.StructField("bag", T.BinaryType()), T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, t, h in _read(batch.column(1)):
                order = np.lexsort((h, t))
                t, h = t[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                at = np.arange(len(h))
                again = at - np.maximum.accumulate(np.where(new, at, 0))
                numbered = mix(h + mix(again.astype(U64)))
                bounds = np.searchsorted(t, np.arange(n + 1))
                out += [numbered[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def _common(rows: list[bytes]) -> np.ndarray:
    """How many features each two rows have in common, as products of slices of the features that several rows have."""
    size = np.array([len(x) // 8 for x in rows])
    _, place, count = np.unique(np.frombuffer(b"".join(rows), U64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), size)
    some = count[place] > 1
    owner, place = owner[some], (np.cumsum(count > 1) - 1)[place[some]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out, width = np.zeros((len(rows), len(rows))), 2048
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (low, low + width))
        x = np.zeros((len(rows), width), np.float32)
        np.add.at(x, (owner[a:b], place[a:b] - low), 1)
        out += x @ x.T
    return out


def _large_bands(rest: DataFrame, texts: DataFrame, threshold: tuple[int, int], block: int) -> DataFrame:
    """For each member of a large band and each other component there, the likeliest link, to be compared exactly.

    A band's members are dealt to blocks of about ``block`` by hash, and each two blocks are a group.
    """
    above, below = threshold
    blocks = F.ceil(F.col("size") / block)
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("bag", "band"), blocks).cast("int"))
    spread = dealt.select("band", "bag", "component", "block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
    spread = spread.select("band", "bag", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    held = spread.join(_features(texts), "bag")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(table: pa.Table) -> pa.Table:
        bags, parts, blocks = table["bag"].to_pylist(), table["component"].to_pylist(), np.asarray(table["block"])
        part = np.unique(np.array(parts, dtype=object).astype("S32"), return_inverse=True)[1]
        a, b = [], []
        if len(set(parts)) > 1:
            rows = table["features"].to_pylist()
            size = np.array([len(x) // 8 for x in rows], float)
            inter = _common(rows)
            excess = below * inter - above * (size[:, None] + size[None] - inter)
            excess[part[:, None] == part[None]] = -1
            if len(set(blocks.tolist())) > 1:  # pairs within a block have a group of their own
                excess[blocks[:, None] == blocks[None]] = -1
            for i in np.flatnonzero((excess >= 0).any(1)):
                fits = np.flatnonzero(excess[i] >= 0)
                order = fits[np.lexsort((-excess[i, fits], part[fits]))]
                for k in order[np.unique(part[order], return_index=True)[1]]:
                    a.append(max(bags[i], bags[k]))
                    b.append(min(bags[i], bags[k]))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return held.groupBy("band", "i", "j").applyInArrow(run, schema)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (4, 5), small: int = 8, block: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, bag, component, class_id, class_size.

    ``class_id`` is the smallest id of the class; ``component`` tells classes apart even where ids repeat.

    Classes are the connected components of texts whose bags of five-word shingles have a weighted Jaccard
    similarity of at least ``threshold`` (a fraction). Words are lower-cased runs of letters and digits. A text of
    fewer than five words is one shingle of all of them; texts without words, null ones among them, are one class.
    Null ids count as larger than others; tied and repeated rows fall into one class as equal bags do; an empty
    table gives an empty table; other columns are not read. Two similar texts share no band with probability
    (1 - s ** 4) ** 32, 5e-8 at a similarity of 0.8.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(_sketches(docs, id_col, text), "sketches")
    distinct = rows.groupBy("bag").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))  # equal bags have equal bands
    banded = scratch.keep(distinct.select("bag", "n", F.explode("bands").alias("band")), "bands")
    shared = scratch.keep(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    total = banded.count()
    member = scratch.keep(join_groups(banded, shared, "band", total), "members")
    scratch.discard("bands", "shared")
    central = scratch.keep(member.groupBy("bag").agg(F.sum("size").alias("central")), "central")
    hubs = member.join(central, "bag").groupBy("band").agg(F.max(F.struct("central", "bag", "n")).alias("hub"), F.max("size").alias("size"))
    hubs = scratch.keep(hubs.select("band", F.col("hub.bag").alias("hub"), F.col("hub.n").alias("hub_n"), "size"), "hubs")
    star = join_groups(member.drop("size"), hubs, "band", total).where((F.col("bag") != F.col("hub")) & _compatible(threshold, "n", "hub_n")).select(F.col("bag").alias("a"), F.col("hub").alias("b")).distinct()
    # One text of each bag that shares a band.
    texts = with_bag(docs.select(docs[text].alias("text")), "text", "bag").select("bag", F.coalesce("text", F.lit("")).alias("text"))
    # Copies fold to one a task before the shuffle. Joined alike at every size: a broadcast would only serve tables so
    # small that nothing is gained.
    texts = texts.groupBy("bag").agg(F.any_value("text").alias("text"))
    texts = scratch.keep(texts.join(central.select("bag").hint("merge"), "bag", "left_semi"), "texts")
    links = _Links(scratch, texts, threshold)
    links.compare(scratch.keep(star, "stars"))
    found = scratch.keep(links.components(), "found")
    named = member.join(found, "bag", "left").withColumn("component", F.coalesce("component", "bag"))
    named = scratch.keep(named, "named")
    apart = named.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("size").alias("size")).where("least <> most").select("band", "size")
    rest = scratch.keep(join_groups(named.drop("size"), scratch.keep(apart, "apart"), "band", total), "rest")
    scratch.discard("named", "members", "hubs", "stars")
    pairs = _small_bands(rest.where(F.col("size") <= small), threshold).unionByName(_large_bands(rest.where(F.col("size") > small), texts, threshold, block))
    pairs = scratch.keep(pairs.distinct(), "pairs")
    if not pairs.isEmpty():
        links.compare(pairs)
        found = links.components()
    classed = rows.select("id", "bag").join(found, "bag", "left").withColumn("component", F.coalesce("component", "bag"))
    classed = scratch.keep(classed, "classed")
    names = scratch.keep(classed.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    scratch.keep_only("classed", "classes")
    every = join_groups(classed, names, "component", classed.count())
    return every.select(F.col("id").alias(id_col), "bag", "component", "class_id", F.col("size").alias("class_size"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row of each class of ``near_classes``, that of the smallest id, with all its columns, whatever their names."""
    classes = near_classes(docs, id_col, text, scratch=scratch)
    # Ids without a value come last; of rows that share the smallest id one stays.
    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("bag").alias("bag")))
    own, known, bag, number = spare(docs, "own_bag", "kept_id", "kept_bag", "number")
    kept = classes.groupBy("component").agg(least.alias("k")).select(F.col("k.id").alias(known), F.col("k.bag").alias(bag))
    found = with_bag(docs, text, own).join(kept, (F.col(own) == F.col(bag)) & F.col(id_col).eqNullSafe(F.col(known)), "left_semi")
    first = Window.partitionBy(own, id_col).orderBy(F.lit(1))
    return found.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(own, number)


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")
