"""Writing results, and changing keyed tables that can't be updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def key_values(row: DataFrame) -> DataFrame:
    """(key, value) rows of a row's plain columns; nested columns are passed over."""
    plain = [f.name for f in row.schema if not hasattr(f.dataType, "elementType") and not hasattr(f.dataType, "fields") and not hasattr(f.dataType, "keyType")]
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in plain])))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected values by file: (filename, doc_type, field, expected) from a JSON file of documents."""
    expected = "name string, percentage string, obtained_marks string, total_marks string, result string"
    docs = spark.read.schema(f"documents array<struct<filename: string, doc_type: string, expected: struct<{expected.replace(' string', ': string')}>>>").json(path, multiLine=True).select(F.inline("documents"))
    return docs.select("filename", "doc_type", F.inline(F.array(*[F.struct(F.lit(c.split()[0]).alias("field"), F.col(f"expected.{c.split()[0]}").alias("expected")) for c in expected.split(", ")])))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Files with their kind by first bytes and a content key."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").otherwise("unknown")
    return spark.read.format("binaryFile").load(path).select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("content_key"))


def single(rows: DataFrame) -> DataFrame:
    """The only row; fails if there is none or more than one."""
    two = rows.limit(2)
    n = two.agg(F.count(F.lit(1)).alias("_n"))
    return two.crossJoin(n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` over those of ``old`` with the same keys; of several with the same keys the one whose columns come first in order."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    first = Window.partitionBy(*keys).orderBy("_age", *[c for c in old.columns if c not in keys])
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_age")


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose keys it doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def fold_events(start: DataFrame, events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """Each row's state after its last event; claims, releases and decisions are events, never updates in place. Of events at one time the largest state counts."""
    last = events.groupBy(key).agg(F.max_by(state, F.struct(order, state)).alias("_state"))
    return start.join(last, key, "left").withColumn(state, F.coalesce("_state", state)).drop("_state")


def bulk_update(rows: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``value`` in the rows whose key is named, if still waiting."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_hit") & F.col(column).isin("pending", "in_review"), value).otherwise(F.col(column))).drop("_hit")
