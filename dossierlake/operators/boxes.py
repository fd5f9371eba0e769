"""Boxes of a page in relation to each other: groups of readings, rows, values beside their labels, and cells of a grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dossierlake.operators import layout as ly
from dossierlake.operators.layout import PAGE


def box_groups(words: DataFrame, least: float = 0.4, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, page, word_id, leader, place) and the columns of ``keep``: each box with the box that leads its group, and the group's place in reading order.

    Boxes are gone through by number: one that no leader has taken leads a group and takes all boxes, not yet taken,
    that it overlaps by more than ``least`` of their union. So a box leads if none that it overlaps leads before it,
    and else follows the first such. Groups go by their leader's row of 15 pixels, then from the left. Boxes are dealt
    by page once and sorted within their partitions, and a task holds a page at a time and a batch of rows: boxes
    cross no join, whose broadcast of them Spark would choose by the size of the texts that they come from. Repeated
    numbers aren't allowed on a page; boxes without a page or a number have no part.
    """
    sides = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    there = words.where(" AND ".join(f"{c} IS NOT NULL" for c in (*PAGE, "word_id")))
    dealt = there.select(*PAGE, "word_id", *keep, *sides).repartition(*PAGE).sortWithinPartitions(*PAGE, "word_id")
    numbers = F.lit(None).cast(words.schema["word_id"].dataType)
    shape = words.select(*PAGE, "word_id", numbers.alias("leader"), F.lit(None).cast("int").alias("place"), *keep).schema
    shape = StructType([StructField(f.name, f.dataType) for f in shape])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in ly.whole_pages(batches):
            yield _grouped(rows, least, keep)

    return dealt.mapInArrow(run, shape)


def _overlapping(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of two boxes of a page that overlap by more than ``least``, by the later and then the earlier one.

    Going down a page, each box is held against the next, the next but one and so on while these begin above its end.
    """
    down = np.lexsort((y1, page))
    page, x1, y1, x2, y2 = (v[down] for v in (page, x1, y1, x2, y2))
    area = (x2 - x1) * (y2 - y1)
    upper, found = np.arange(len(down)), [np.empty((2, 0), np.int64)]
    for far in range(1, len(down)):
        upper = upper[upper + far < len(down)]
        upper = upper[(page[upper + far] == page[upper]) & (y1[upper + far] < y2[upper])]
        if not len(upper):
            break
        across = np.minimum(x2[upper], x2[upper + far]) - np.maximum(x1[upper], x1[upper + far])
        i, across = upper[across > 0], across[across > 0]
        j = i + far
        shared = across * (np.minimum(y2[i], y2[j]) - y1[j])
        near = (shared > 0) & (np.floor(shared / (area[i] + area[j] - shared) * 1e6 + 0.5) / 1e6 > least)
        found.append(np.stack([down[i[near]], down[j[near]]]))
    pairs = np.sort(np.concatenate(found, axis=1), axis=0)
    earlier, later = pairs[:, np.lexsort(pairs)]
    return earlier, later


def _grouped(rows: pa.RecordBatch, least: float, keep: Sequence[str]) -> pa.RecordBatch:
    n, starts = rows.num_rows, ly.page_starts(rows)
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    x1, y1, x2, y2 = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2"))
    leader = list(range(n))
    for a, b in zip(*(v.tolist() for v in _overlapping(page, x1, y1, x2, y2, least)), strict=True):
        if leader[a] == a and leader[b] == b:
            leader[b] = a
    leads = np.array(leader)
    heads = np.flatnonzero(leads == np.arange(n))
    first = lambda v: np.where(np.isnan(v), -np.inf, v)[heads]
    heads = heads[np.lexsort((heads, first(x1), first(np.floor(y1 / 15)), page[heads]))]
    place = np.zeros(n, np.int32)
    place[heads] = np.arange(len(heads)) - np.searchsorted(page[heads], page[heads]) + 1
    found = {"leader": rows.column("word_id").take(pa.array(leads)), "place": pa.array(place[leads])}
    return pa.RecordBatch.from_pydict({c: found[c] if c in found else rows.column(c) for c in (*PAGE, "word_id", "leader", "place", *keep)})


def box_rows(words: DataFrame, gap: float = 20.0) -> DataFrame:
    """Adds ``row``: from the top, a box begins a row if it is more than ``gap`` below all boxes before it."""
    order = Window.partitionBy(*PAGE).orderBy("y1", "word_id")
    reach = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = words.withColumn("new_", F.when(F.col("y1") > reach + gap, 1).otherwise(0))
    return x.withColumn("row", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


class Field(NamedTuple):
    """Labels and values of a field, and how far to the right and below its label a value's centre may be; without a reach the label is the value."""

    labels: str
    value: str
    right: float
    below: float


#: The fields, their labels and values as patterns, and their reach in pixels.
FIELDS = {
    "percentage": Field(r"percent(?:age)?|total\s*%|marks\s*%|टक्के|aggregate|overall", r"[0-9]{1,3}(?:\.[0-9]{1,2})?%?", 300, 80),
    "cgpa": Field(r"cgpa|sgpa|gpa|grade\s*point", r"[0-9]{1,2}(?:\.[0-9]{1,2})?", 250, 80),
    "result": Field(r"result|decision|परिणाम|निर्णय", r"[A-Za-z\s]{3,}", 300, 80),
    "grade_class": Field(r"class|division|grade|श्रेणी", r"[A-Za-z\s\+]{3,}", 300, 80),
    "candidate_name": Field(r"name\s*of\s*(?:the\s*)?(?:student|candidate|examinee)|candidate(?:'s)?\s*name|student\s*name|विद्यार्थ्याचे\s*नाव", r"[A-Za-z\s\.]{4,}", 400, 60),
    "board_university": Field(r"board|university|institute|college", r"[A-Za-z\s\.]{5,}", 0, 0),
    "passing_year": Field(r"year\s*of\s*pass(?:ing)?|exam\s*year|year|session|वर्ष", r"20[0-9]{2}", 250, 60),
}


def mapped_fields(words: DataFrame, fields: dict[str, Field] = FIELDS) -> DataFrame:
    """(doc, page, field, label, value, distance): of each page and field the nearest value to its surest label.

    The label is the word of highest confidence that shows one, the first of equals. A value's centre lies from the
    label's right edge on within the field's reach, or from the label's centre down within its reach, to any side; it
    has at most five digits. The nearest centre wins, the first of equals. A field whose values aren't looked for has
    its label's own text. A page has a label a field at most, and these meet its words.
    """
    shown = F.array(*[F.when(F.col("text").rlike(f"(?i)(?:{f.labels})"), F.lit(name)) for name, f in fields.items()])
    hits = words.select(*PAGE, F.explode(F.array_compact(shown)).alias("field"), F.struct((-F.col("conf")).alias("unsure"), "word_id", "text", "x1", "y1", "x2", "y2").alias("w"))
    labels = hits.groupBy(*PAGE, "field").agg(F.min("w").alias("w"))
    labels = labels.select(*PAGE, "field", F.col("w.word_id").alias("label_id"), F.col("w.text").alias("label"), F.col("w.x2").alias("edge"), ((F.col("w.x1") + F.col("w.x2")) / 2).alias("lx"), ((F.col("w.y1") + F.col("w.y2")) / 2).alias("ly"))
    reach = F.create_map(*[x for name, f in fields.items() for x in (F.lit(name), F.struct(F.lit(f"(?i){f.value}").alias("value"), F.lit(float(f.right)).alias("right"), F.lit(float(f.below)).alias("below")))])
    labels = labels.withColumn("r", F.element_at(reach, F.col("field")))
    alone = [name for name, f in fields.items() if not f.right and not f.below]
    own = labels.where(F.col("field").isin(alone)).select(*PAGE, "field", "label", F.trim("label").alias("value"), F.lit(0.0).alias("distance"))
    values = words.select(*PAGE, "word_id", F.trim("text").alias("value"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")).where(F.regexp_count("value", F.lit("[0-9]")) <= 5)
    across, down = F.col("cx") - F.col("edge"), F.col("cy") - F.col("ly")
    within = (across.between(0, F.col("r.right"))) | (down.between(0, F.col("r.below")))
    far = F.sqrt((F.col("cx") - F.col("lx")) ** 2 + down**2)
    met = labels.where(~F.col("field").isin(alone)).join(values, PAGE).where((F.col("word_id") != F.col("label_id")) & within & F.rlike("value", F.col("r.value")))
    best = met.groupBy(*PAGE, "field", "label").agg(F.min(F.struct(far.alias("distance"), "word_id", "value")).alias("b"))
    return best.select(*PAGE, "field", "label", "b.value", F.round("b.distance", 6).alias("distance")).unionByName(own)


def column_grid(words: DataFrame, width: int = 1488, least: int = 18) -> DataFrame:
    """(doc, page, line, cells) of the table of each page, from words with ``line``.

    The table is the block of lines that ``layout.row_blocks`` finds, its columns are parted where none of its words
    stands, and a word is in the column that its centre falls in, the last if in none. A page's cut points are an
    array in which each word looks its column up.
    """
    sized = words.groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("tokens"))
    block = ly.row_blocks(sized).where("block = 'table'").select(*PAGE, "line")
    inside = words.join(block, [*PAGE, "line"], "left_semi")
    columns = ly.column_gaps(inside, width, least).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "x_left", "x_right"))), lambda c: F.struct(c["x_left"].alias("a"), c["x_right"].alias("b"))).alias("columns"))
    placed = inside.join(columns, PAGE)
    found = F.filter(F.transform("columns", lambda c, i: F.when((F.col("cx") >= c["a"]) & (F.col("cx") < c["b"]), i)), lambda i: i.isNotNull())
    x = placed.withColumn("column", F.coalesce(F.get(found, F.lit(0)), F.size("columns") - 1))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_id", F.trim("text").alias("text")))), lambda w: w["text"]), " ")
    cells = x.groupBy(*PAGE, "line", "column").agg(cell.alias("text"), F.max(F.size("columns")).alias("n"))
    rows = cells.groupBy(*PAGE, "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("held"), F.max("n").alias("n"))
    return rows.select(*PAGE, "line", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.element_at("held", k), F.lit(""))).alias("cells"))
