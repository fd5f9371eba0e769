"""Columns that an operator adds to a caller's table, and joins with groups of very uneven sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group counts as large if it has more than this part of all rows, so there are fewer large groups than this.
PARTS = 4096


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, a row a key with its ``size`` among the ``total`` rows.

    Large groups, of which there are fewer than ``PARTS``, are broadcast, so no task gets all rows of one. The rest
    is shuffled by key.
    """
    large = F.broadcast(groups.where(F.col("size") > total / PARTS))  # fewer than PARTS rows
    others = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col("size") <= total / PARTS), key)
    return rows.join(large, key).unionByName(others)
