"""Keyed tables that are changed by versions: only the buckets that a change touches are written anew.

A table is a folder. Rows lie in buckets by the hash of their keys, a bucket's files never change, and a version is a
small file that says for each bucket which version wrote it last. It is written after all data, under its own name, so
a change that fails leaves the version before, and a reader of an older version finds all its files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.sources import sinks

BUCKET = "bucket_"


@dataclass(frozen=True)
class Change:
    """What a change did: its version, the buckets written anew and their bytes, and those of the whole table."""

    version: int
    buckets: int
    bytes_written: int
    bytes_total: int


class KeyedTable:
    """Rows by ``keys`` in ``buckets`` buckets below ``path``, a folder that all executors share.

    Null keys are keys like any other. All changes go through one writer at a time; a second one that takes the same
    version fails, and its data is never read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _system(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, system = self._system(f"{self.path}/versions")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in system.listStatus(at)) if system.exists(at) else []

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise ValueError(f"there is no table at {self.path}")
        at, system = self._system(f"{self.path}/versions/{known[-1] if version is None else version}.json")
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        at, system = self._system(f"{self.path}/versions/{manifest['version']}.json")
        stream = system.create(at, False)  # fails if another writer has taken this version
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _size(self, where: dict[str, int], of: set[str] | None = None) -> int:
        total = 0
        for bucket, version in where.items():
            if of is None or bucket in of:
                at, system = self._system(f"{self.path}/data/{version}/{BUCKET}={bucket}")
                total += system.getContentSummary(at).getLength() if system.exists(at) else 0
        return total

    def _written(self, rows: DataFrame, version: int) -> None:
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{version}")

    def create(self, rows: DataFrame) -> Change:
        """The first version; ``rows`` have each key once."""
        self._written(self._bucketed(rows), 0)
        where = {str(b): 0 for b in range(self.buckets)}
        self._commit({"version": 0, "schema": rows.schema.json(), "where": where, "batch": None})
        return Change(0, self.buckets, size := self._size(where), size)

    def _read(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = []
        for bucket, version in manifest["where"].items():
            path = f"{self.path}/data/{version}/{BUCKET}={bucket}"
            at, system = self._system(path)
            if (buckets is None or bucket in buckets) and system.exists(at):  # an empty bucket has no folder
                paths.append(path)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one unless it is named."""
        return self._read(self._manifest(version))

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> Change:
        """The next version: ``merge`` of the old rows of the touched buckets and of ``changes``, in these buckets.

        A stream names its ``batch``: one that the table has seen changes nothing.
        """
        now = self._manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return Change(now["version"], 0, 0, self._size(now["where"]))
        dealt = self._bucketed(changes)
        touched = {str(r[0]) for r in dealt.select(BUCKET).distinct().collect()}  # at most ``buckets`` numbers
        version, where = now["version"] + 1, dict(now["where"])
        if touched:
            self._written(self._bucketed(merge(self._read(now, touched), changes)), version)
            where |= dict.fromkeys(touched, version)
        self._commit({"version": version, "schema": now["schema"], "where": where, "batch": now["batch"] if batch is None else batch})
        return Change(version, len(touched), self._size(where, touched), self._size(where))

    def upsert(self, changes: DataFrame, batch: int | None = None) -> Change:
        """Rows of ``changes`` in place of those with the same keys; see ``sinks.upsert``."""
        return self.change(changes, lambda old, new: sinks.upsert(old, new, self.keys), batch)

    def replace(self, changes: DataFrame, batch: int | None = None) -> Change:
        """All rows of ``changes`` in place of all rows with their keys."""
        return self.change(changes, lambda old, new: sinks.replace_by_key(old, new, self.keys), batch)

    def keep_latest(self, changes: DataFrame, order: Sequence[str], batch: int | None = None) -> Change:
        """Of old and new rows with the same keys the one that is last by ``order`` (null first), so a late older row changes nothing."""

        def last(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in self.keys and c not in order]
            both = old.unionByName(new)
            top = both.groupBy(*self.keys).agg(F.max(F.struct(*order, *rest)).alias("top_"))
            return top.select(*self.keys, "top_.*").select(*old.columns)

        return self.change(changes, last, batch)
