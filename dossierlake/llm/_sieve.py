"""A filter of fixed size that lets all of a set of hashes through, and others seldom."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm._bytes import U64

#: Bits of the filter; its size never grows.
SIEVE = 1 << 26


def sieve(hashes: DataFrame, column: str) -> np.ndarray:
    """Packed bits, two for each of ``hashes``. Rows are folded to at most SIEVE / 64 words before they come to the driver."""
    h = F.col(column)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(SIEVE - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SIEVE - 1)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(SIEVE >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that pass."""

    def lit(p: np.ndarray) -> np.ndarray:
        return (bits[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & 1 > 0

    first = np.flatnonzero(lit(hashes & U64(SIEVE - 1)))
    return first[lit((hashes[first] >> U64(32)) & U64(SIEVE - 1))]
