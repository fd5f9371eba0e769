"""Tables that an operator writes between two passes, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from dossierlake.sources.shared import shared_root


_open: list[list[Scratch]] = []


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables of all operators that run inside, once what is written inside no longer reads them."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.discard()


class Scratch:
    """Names and writes the tables of one run of an operator.

    Tables are ordinary Parquet: a lost executor loses none of them, and reading one cuts the lineage.
    ``discard`` removes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{operator}-{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the table as read back."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def discard(self, *names: str) -> None:
        """Removes the named tables, or all of them."""
        for path in [self.at(n) for n in names] or [self.path]:
            at, system = self._folder(path)
            system.delete(at, True)

    def keep_only(self, *names: str) -> None:
        """Removes all tables but the named, which a result still reads."""
        at, system = self._folder(self.path)
        for entry in system.listStatus(at):
            if entry.getPath().getName() not in names:
                system.delete(entry.getPath(), True)
