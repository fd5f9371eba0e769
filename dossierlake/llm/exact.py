"""Exact deduplication as a stateful stream.

Every row arrives as (digest, id, place). A stream folds arrivals into state kept by digest in RocksDB, on disk and
without expiry: the stable identifier of the row that stays, its place among the arrivals, and the number of rows.
Rows of one digest are folded in each task before the shuffle, so a group of copies costs a task one row, however
large. Digest and identifier locate a row's content in the source. Arrivals whose digest is met again are hits:
their full bytes are fetched by that locator and compared with those of the row that stays, of which a group has one
copy for some hundred hits, so its comparisons are spread over tasks. If any differ, the whole run is repeated with
the next, wider digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm._columns import join_groups, spare
from dossierlake.llm._scratch import Scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the state is kept. Stores are many and small, so none reserves disk ahead.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Hits of a group that are compared with one copy of the text that stays.
HITS = 256


def _digest(name: str, text: Column) -> Column:
    if name == "crc32":
        return F.unhex(F.lpad(F.hex(F.crc32(text)), 8, "0"))
    return F.unhex(F.sha2(text, int(name.removeprefix("sha"))))


def _fold(scratch: Scratch, arrivals: DataFrame, name: str, files_per_batch: int) -> DataFrame:
    """The state after all arrivals: digest, keep (id and place), size."""
    spark = scratch.spark
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(scratch.at(name))
    state = stream.groupBy("digest").agg(F.max(F.struct("known", "id", "place")).alias("keep"), F.count(F.lit(1)).alias("size"))
    scratch.keep(spark.createDataFrame([], state.schema), f"{name}-updates/batch=-1")  # so that there is a folder without any arrival
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # A batch that is tried again writes the same folder again.
        writer = state.writeStream.outputMode("update").option("checkpointLocation", scratch.at(f"{name}-state")).trigger(availableNow=True)
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").option("compression", "zstd").parquet(scratch.at(f"{name}-updates/batch={n}"))).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(state.schema).parquet(scratch.at(f"{name}-updates"))
    # The state of a digest only grows, so its last update has the largest of each.
    groups = scratch.keep(updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("size").alias("size")), f"{name}-groups")
    scratch.discard(f"{name}-updates", f"{name}-state")
    return groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digests: Sequence[str] = ("sha256", "sha512"), files_per_batch: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, digest, keep_id, group_size, kept, and the text's sha256 whichever digest told texts apart.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays;
    a null id is smaller than any other, and of rows that share id and text one stays. Empty tables give empty
    tables; other columns are not read. Every text is hashed and, in groups, compared whole.
    """
    rows, _ = _resolve(docs, id_col, text, digests, files_per_batch, scratch or Scratch(docs.sparkSession, "exact"))
    return rows.select(F.col("id").alias(id_col), "digest", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), "kept", "sha256")


def _resolve(docs: DataFrame, id_col: str, text: str, digests: Sequence[str], files_per_batch: int, scratch: Scratch) -> tuple[DataFrame, str]:
    """The arrivals with their groups, and the digest that told all texts apart."""
    body = F.coalesce(docs[text], F.lit(""))
    for name in digests:
        also = [] if name == "sha256" else [_digest("sha256", body).alias("sha256")]
        arrivals = scratch.keep(docs.select(docs[id_col].isNotNull().alias("known"), docs[id_col].alias("id"), _digest(name, body).alias("digest"), F.monotonically_increasing_id().alias("place"), *also), name)
        groups = _fold(scratch, arrivals, name, files_per_batch)
        rows = join_groups(arrivals, groups, "digest", arrivals.count())
        if name == "sha256":
            rows = rows.withColumn("sha256", F.col("digest"))
        if _bytes_agree(scratch, docs.select(docs[id_col].alias("id"), body.alias("body"), _digest(name, body).alias("digest")), rows, name):
            return rows.withColumn("kept", F.col("place") == F.col("keep.place")), name
        scratch.discard(name, f"{name}-groups")
    raise ValueError("different texts share every digest; name a wider one")


def _bytes_agree(scratch: Scratch, texts: DataFrame, rows: DataFrame, name: str) -> bool:
    """Whether every hit has the bytes of the row that stays.

    Hits are found by digest and id. Rows without id, or of one id, can make such a key large, so it has its own size.
    """
    own = F.concat(F.hex("digest"), F.coalesce(F.concat(F.lit(":"), F.col("id").cast("string")), F.lit("")))
    several = rows.where(F.col("size") > 1)
    hits = several.groupBy("digest", "id").agg(F.any_value("keep.id").alias("keep_id"), F.max("size").alias("group"), F.count(F.lit(1)).alias("size"))
    # Keys are as many as hits, so they are shuffled at every size; without the hint a small table's would be broadcast.
    keys = hits.select(own.alias("own"), "keep_id", "group", "size").hint("merge")
    found = join_groups(texts.withColumn("own", own), keys, "own", several.count()).select("digest", "id", "body", "keep_id", F.col("group").alias("size"))
    found = scratch.keep(found, f"{name}-hits")
    # Of rows that share the id that stays, any one serves: the others are compared with it.
    kept = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.any_value("body").alias("kept_body"), F.max("size").alias("size"))
    copies = F.ceil(F.col("size") / HITS)
    kept = kept.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("copy"))
    dealt = found.withColumn("copy", F.pmod(F.xxhash64(F.monotonically_increasing_id()), copies).cast("int"))
    agree = dealt.join(kept, ["digest", "copy"]).where(F.col("body") != F.col("kept_body")).isEmpty()
    scratch.discard(f"{name}-hits")
    return agree


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; see ``exact_groups``."""
    rows, name = _resolve(docs, id_col, text, ("sha256", "sha512"), 64, scratch or Scratch(docs.sparkSession, "exact"))
    own, known, digest = spare(docs, "own_digest", "kept_id", "kept_digest")
    kept = rows.where("kept").select(F.col("id").alias(known), F.col("digest").alias(digest))
    keyed = docs.withColumn(own, _digest(name, F.coalesce(docs[text], F.lit(""))))
    found = keyed.join(kept, (F.col(own) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(known)), "left_semi")
    # Rows that share id and text are told apart by nothing but their place, so any one of them stays, of each task first.
    return found.dropDuplicates([own, id_col]).drop(own)


def op5_exact(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts in ``documents``."""
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
