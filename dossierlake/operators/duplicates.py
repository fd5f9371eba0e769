"""Near-duplicate images by perceptual hash."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest distances of identical, near and similar images.
IDENTICAL, NEAR, SIMILAR = 3, 10, 20
#: The distance of hashes of different lengths.
INCOMPARABLE = 999


def bits(digits: Column) -> Column:
    """A hash of up to 16 hex digits as one signed number of 64 bits."""
    return F.conv(digits, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; hashes of different lengths can't be compared."""
    return F.when(F.length(a) == F.length(b), F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(INCOMPARABLE)


def similarity(distance: Column, bits: int = 64) -> Column:
    """Whole percent of equal bits, cut off, never below 0."""
    return F.greatest(F.lit(0), F.floor((1 - distance / F.lit(float(bits))) * 100)).cast("int")


def match_class(distance: Column) -> Column:
    return F.when(distance <= IDENTICAL, "IDENTICAL").when(distance <= NEAR, "NEAR_DUPLICATE").when(distance <= SIMILAR, "SIMILAR").otherwise("DIFFERENT")


KINDS = ("phash", "ahash", "dhash")
#: Bands of 16 bits into which a hash is cut, hashes of a block, and pairs that a task compares at once.
BANDS, BLOCK, AT_ONCE = 4, 1 << 18, 1 << 16


def _masks(most: int) -> list[int]:
    """All numbers of 16 bits with at most ``most`` bits set."""
    return [sum(1 << i for i in on) for k in range(most + 1) for on in combinations(range(16), k)]


def image_hashes(hashes: DataFrame) -> DataFrame:
    """Each document and kind with its hash: the class that ``near_images`` links."""
    return hashes.select("document_id", "user_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hash")) for k in KINDS])))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """Each distinct hash of a kind with the documents and users that have it."""
    return image_hashes(hashes).where(F.col("hash").isNotNull()).groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("documents"), F.min("document_id").alias("first_document"), F.min("user_id").alias("least_user"), F.max("user_id").alias("most_user"))


def near_images(hashes: DataFrame, threshold: int = NEAR) -> DataFrame:
    """Pairs of distinct hashes of a kind within ``threshold`` bits that documents of different users have, equal ones as a pair of themselves.

    Pairs are of hashes, not of documents, so copies are never expanded; ``image_hashes`` tells the documents of each.
    Hashes are dealt into blocks of about ``BLOCK``, by the number of rows, and each two blocks of a kind meet in one
    task, which looks up near band values of one in the other: every hash goes to as many tasks as there are blocks.
    """
    classes = hash_classes(hashes)
    blocks = -(-hashes.count() // BLOCK) or 1
    coded = classes.withColumn("code", bits(F.col("hash"))).where(F.col("code").isNotNull()).withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    held = ["hash", "code", "documents", "least_user", "most_user"]
    met = coded.select("kind", F.length("hash").alias("digits"), "block", every, *held)
    met = met.select("kind", "digits", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), *held)
    sides = [f"{c}_{side} {kind}" for side in ("a", "b") for c, kind in (("hash", "string"), ("documents", "long"), ("least_user", met.schema["least_user"].dataType.simpleString()), ("most_user", met.schema["most_user"].dataType.simpleString()))]

    def pairs_of(rows: pa.Table) -> pa.Table:
        code, second = (rows.column(c).to_numpy() for c in ("code", "second"))
        first, other = np.flatnonzero(~second), np.flatnonzero(second)
        alone = rows.column("low")[0] == rows.column("high")[0]
        i, j, distance = near_codes(code[first], None if alone else code[other], threshold)
        sides = {"a": rows.take(pa.array(first[i])), "b": rows.take(pa.array((first if alone else other)[j]))}
        found = {"kind": sides["a"].column("kind"), "distance": pa.array(distance, pa.int32())}
        return pa.table(found | {f"{c}_{s}": x.column(c) for s, x in sides.items() for c in ("hash", "documents", "least_user", "most_user")})

    near = met.groupBy("kind", "digits", "low", "high").applyInArrow(pairs_of, ", ".join(["kind string, distance int", *sides]))
    shown = ["kind", F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b"), "distance"]
    turned = F.col("hash_a") < F.col("hash_b")
    shown += [F.when(turned, F.col(f"documents_{x}")).otherwise(F.col(f"documents_{y}")).alias(f"documents_{x}") for x, y in (("a", "b"), ("b", "a"))]
    users = F.least("least_user_a", "least_user_b") < F.greatest("most_user_a", "most_user_b")
    pairs = near.where(users).select(*shown)
    same = classes.where("least_user < most_user").select("kind", F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance"), F.col("documents").alias("documents_a"), F.col("documents").alias("documents_b"))
    return pairs.unionByName(same).withColumns({"similarity": similarity(F.col("distance")), "match_class": match_class(F.col("distance"))})


def near_codes(a: np.ndarray, b: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a, places in b, distance) of numbers of 64 bits within ``threshold`` bits, each pair once; without ``b`` the pairs within ``a``.

    Radii of the four bands add up so that numbers within the threshold are within one band's radius at least: for 10
    bits 2, 2, 2 and 1. Numbers are sorted by a band, and for each mask of so many bits those of ``a`` find the stretch
    of ``b`` that has their band's value after it. Compared are at most about ``AT_ONCE`` pairs at a time.
    """
    alone, u = b is None, lambda v: np.ascontiguousarray(v).view(np.uint64)
    a, b = u(a), u(a if b is None else b)
    least, more = divmod(threshold + 1, BANDS)
    found = [np.empty((3, 0), np.int64)]
    for band in range(BANDS):
        radius = least - 1 + (band < more)
        if radius < 0:
            continue
        value = lambda v: ((v >> np.uint64(16 * band)) & np.uint64(0xFFFF)).astype(np.int64)  # noqa: E731, B023
        ia, ib = np.argsort(value(a), kind="stable"), np.argsort(value(b), kind="stable")
        sa, sb = a[ia], b[ib]
        va, begins = value(sa), np.searchsorted(value(sb), np.arange((1 << 16) + 1)).astype(np.int32)
        for mask in _masks(radius):
            low = begins[va ^ mask]
            many = begins[(va ^ mask) + 1] - low
            ends = np.cumsum(many, dtype=np.int64)
            at = 0
            while at < len(sa):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                n = many[at:to]
                shift = low[at:to] - (ends[at:to] - n - done).astype(np.int32)
                j = np.repeat(shift, n) + np.arange(ends[to - 1] - done, dtype=np.int32)
                distance = np.bitwise_count(np.repeat(sa[at:to], n) ^ sb[j])
                hit = np.flatnonzero(distance <= threshold)
                if len(hit):
                    i, j = ia[at + np.searchsorted(ends[at:to] - done, hit, "right")], ib[j[hit]]
                    on = i < j if alone else np.ones(len(i), bool)
                    found.append(np.stack([i[on], j[on], distance[hit][on]]).astype(np.int64))
                at = to
    i, j, distance = np.concatenate(found, axis=1)
    _, once = np.unique(i * max(1, len(b)) + j, return_index=True)
    return i[once], j[once], distance[once]


def duplicate_score(matches: DataFrame, key: str) -> DataFrame:
    """70 for a shared number, 60, 40 and 20 by class of image match, 100 at most."""
    points = F.when(F.col("match_type").isin("AADHAAR_NUMBER", "PAN_NUMBER"), 70).when(F.col("match_class") == "IDENTICAL", 60).when(F.col("match_class") == "NEAR_DUPLICATE", 40).when(F.col("match_class") == "SIMILAR", 20).otherwise(0)
    return matches.groupBy(key).agg(F.least(F.lit(100), F.sum(points)).alias("duplicate_score"))
