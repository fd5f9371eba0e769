"""Lines, phrases, regions and tables from positioned words.

Words come as rows (doc, page, word_id, text, conf, x1, y1, x2, y2). Steps that look only at neighbours are windows
over (doc, page); steps that carry a running mean or a growing row are folds over the array of a page's words or lines, so
work is spread by page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]
#: What is too uncertain or too small to be a word.
LEAST_CONF, LEAST_WIDTH, LEAST_HEIGHT = 0.55, 2, 3
#: Row tolerance by policy, as a factor of the median height, a floor and a ceiling.
TOLERANCE = {"line": (0.55, 5.0, None), "strict": (0.70, 3.0, 30.0), "block": (0.55, 6.0, None)}
#: What looks like a date or an amount in a table's row.
DATE = r"(?i)\b(\d{1,2}[-/\s]?\w{3}|\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"
AMOUNT = r"\b\d[\d,]*\.?\d*\b"


def clean_words(words: DataFrame) -> DataFrame:
    """Words that are certain and large enough, trimmed, with straight quotes, centres and sizes."""
    text = F.trim(F.translate("text", "‘’“”", "''\"\""))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x = words.withColumn("text", text).where((F.col("conf") >= LEAST_CONF) & (w >= LEAST_WIDTH) & (h >= LEAST_HEIGHT) & (F.col("text") != ""))
    return x.withColumns({"width": w, "height": h, "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def median_of(values: Column) -> Column:
    """The median of an array of numbers; null without any."""
    n = F.size(values)
    return F.get(F.transform(F.array(F.array_sort(values)), lambda v: F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)), F.lit(0))


def _numbered(pages: DataFrame, starts: Column, name: str) -> DataFrame:
    """The rows held in each page's array ``held`` (their columns under ``row``), with how many of ``starts``, places in the array, come up to theirs."""
    x = pages.select("held", starts.alias("starts")).select("starts", F.posexplode("held").alias("at", "h"))
    return x.select("h.row.*", F.size(F.filter("starts", lambda s: s <= F.col("at"))).cast("long").alias(name))


def row_bands(words: DataFrame, policy: str = "line") -> DataFrame:
    """Adds ``line``: words from top to bottom stay in a line while their centre is near the mean centre of the line so far.

    A page's words are an array that one fold goes through, keeping the line's sum and count and where lines begin.
    """
    factor, floor, ceiling = TOLERANCE[policy]
    held = F.array_sort(F.collect_list(F.struct("cy", "x1", "word_id", F.struct(*words.columns).alias("row"))))
    pages = words.groupBy(*PAGE).agg(held.alias("held"), F.median(F.when(F.col("height") > 2, F.col("height"))).alias("tall"))
    tolerance = F.greatest(F.lit(floor), F.coalesce("tall", F.lit(12.0)) * factor)
    tolerance = F.least(tolerance, F.lit(ceiling)) if ceiling else tolerance
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("count"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, w: Column) -> Column:
        new = F.when(s["count"] > 0, F.abs(w["cy"] - s["total"] / s["count"]) > F.col("tolerance")).otherwise(False)
        return F.struct((s["at"] + 1).alias("at"), (F.when(new, 0.0).otherwise(s["total"]) + w["cy"]).alias("total"), (F.when(new, 0).otherwise(s["count"]) + 1).alias("count"), F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

    return _numbered(pages.withColumn("tolerance", tolerance), F.aggregate("held", start, step)["starts"], "line")


def phrases(words: DataFrame) -> DataFrame:
    """Neighbours on a line merged while the gap is at most 1.8 median character widths of the line, 8 at least: an exact gap-and-island."""
    line = Window.partitionBy(*PAGE, "line")
    ordered = line.orderBy("x1", "word_id")
    char = F.median(F.when(F.col("width") > 0, F.col("width") / F.length("text"))).over(line)
    x = words.withColumn("limit", F.greatest(F.lit(8.0), char * 1.8)).withColumn("gap", F.col("x1") - F.lag("x2").over(ordered))
    x = x.withColumn("phrase", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_id", "text"))), lambda w: w["text"]), " ")
    g = x.groupBy(*PAGE, "line", "phrase").agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("words"))
    return g.withColumn("cx", (F.col("x1") + F.col("x2")) / 2)


def lines(parts: DataFrame) -> DataFrame:
    """One row per line of phrases, with its text from left to right, its extent and the words and numbers it has."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "phrase", "text"))), lambda p: p["text"]), " ")
    g = parts.groupBy(*PAGE, "line").agg(text.alias("text"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("text").rlike("[0-9]")).alias("numbers"))
    return g.withColumn("cy", (F.col("y1") + F.col("y2")) / 2)


def region_type(width: float, height: float) -> Column:
    """The region of a line by its place, spread, colons and numbers, before smoothing."""
    span = F.col("x2") - F.col("x1")
    colon = F.contains("text", F.lit(":"))
    table = ((F.col("tokens") > 5) & (span / width > 0.4) & (F.col("numbers") >= 2)) | ((F.col("tokens") > 3) & (F.col("numbers") >= 1) & (span > 200))
    return (
        F.when(F.col("cy") < height * 0.18, F.when(colon, "kv_block").otherwise("header"))
        .when(F.col("cy") > height * 0.90, "footer")
        .when(table, "table")
        .when(colon, "kv_block")
        .otherwise("paragraph")
    )


def regions(rows: DataFrame, width: float = 1000.0, height: float = 1600.0) -> DataFrame:
    """Lines with their region. Going down, a paragraph between table rows, or a short one under a table row, joins the table, and the next line sees that.

    Such a paragraph passes on what is above it, so it is a table row if the last line that isn't such a one is.
    """
    down = Window.partitionBy(*PAGE).orderBy("line")
    kind = F.col("region")
    passes = (kind == "paragraph") & F.lag("line").over(down).isNotNull() & ((F.lead("region").over(down) == "table") | ((F.col("tokens") < 5) & F.lead("line").over(down).isNotNull()))
    x = rows.withColumn("region", region_type(width, height)).withColumn("_passes", F.coalesce(passes, F.lit(False)))
    above = F.last(F.when(~F.col("_passes"), kind), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("region", F.when(F.col("_passes") & (above == "table"), "table").otherwise(kind)).drop("_passes")


def x_clusters(parts: DataFrame, share: float = 0.05, width: float = 1000.0) -> DataFrame:
    """Column clusters by the distance to the last centre on the left: a pure gap-and-island."""
    w = Window.partitionBy(*PAGE).orderBy("cx", "line", "phrase")
    gap = F.col("cx") - F.lag("cx").over(w)
    return parts.withColumn("_new", F.when(gap > width * share, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where pages begin in rows sorted by page."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in PAGE:
        code = rows.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by page, cut where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(page_starts(batch)[-1])
        if not last and held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in PAGE):
            yield pa.concat_batches(held)
            held = []
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def column_anchors(centres: list[float], tolerance: float = 45.0) -> list[float]:
    """Means of runs of centres, from left to right, that stay within the tolerance of the mean so far."""
    done, total, count = [], 0.0, 0
    for x in sorted(centres):
        if count and x - total / count > tolerance:
            done.append(total / count)
            total, count = 0.0, 0
        total, count = total + x, count + 1
    return [*done, total / count] if count else done


def _nearest_of(anchors: list[float], x: float) -> int:
    """The place of the nearest of ascending anchors, the first of equals."""
    i = bisect_left(anchors, x)
    return i - 1 if i == len(anchors) or (i and x - anchors[i - 1] <= anchors[i] - x) else i


# Digits, letters and blanks of ASCII alone, as in SQL.
_DATE, _AMOUNT = (re.compile(p.replace(r"\s", r"\t\n\f\r "), re.ASCII) for p in (DATE, AMOUNT))


def _page_grid(parts: list[tuple], most_columns: int) -> list[list[str]]:
    """The rows of a page's table, from its phrases (line, x1, phrase, text, cx), sorted."""
    every = column_anchors([p[4] for p in parts])
    on: list[set] = [set() for _ in every]
    for p in parts:
        on[_nearest_of(every, p[4])].add(p[0])
    anchors = [a for a, lines in zip(every, on, strict=True) if len(lines) >= 2]
    usable = 1 <= len(anchors) <= most_columns
    columns = len(anchors) if usable else 1
    rows: list[list[list[str]]] = []
    reach = 0  # the most cells filled by a line of the run
    for _, line in groupby(parts, key=lambda p: p[0]):
        cells: list[list[str]] = [[] for _ in range(columns)]
        for p in line:
            if p[3] is not None:
                cells[_nearest_of(anchors, p[4]) if usable else 0].append(p[3])
        texts = [" ".join(c).strip(" ") for c in cells]
        filled, whole = sum(x != "" for x in texts), " ".join(x for x, c in zip(texts, cells, strict=True) if c)
        can = bool(rows) and 0 < filled < 0.65 * columns and not _DATE.search(whole) and not (filled >= 2 and _AMOUNT.search(whole))
        if not (can and reach >= 2):
            rows.append([[] for _ in range(columns)])
        reach = max(reach, filled) if can else filled
        for cell, x in zip(rows[-1], texts, strict=True):
            if x:
                cell.append(x)
    return [[" ".join(c) for c in r] for r in rows]


def table_grid(parts: DataFrame, most_columns: int = 12) -> DataFrame:
    """Rows (doc, page, row, cells) of the table of each page, continuation rows appended to the row above.

    Anchors are means of centres, met on two lines or more, and a phrase is in the column of its nearest anchor. With
    too many columns, or none, a line is one cell.
    A row can continue another if it has text in less than .65 of the columns, no date, and no number beside other
    text; it does if the row it would continue has text in two columns. Rows that can't continue begin runs: within a
    run a row continues as soon as any row before it there has two columns filled.
    Phrases are dealt by page once and sorted; a task goes through them with one page at hand and a batch of rows.
    """
    order = ["line", "x1", "phrase", "text"]
    there = parts.where("line IS NOT NULL AND cx IS NOT NULL")
    dealt = there.select(*PAGE, *order, F.col("cx").cast("double").alias("cx")).repartition(*PAGE).sortWithinPartitions(*PAGE, *order)
    shape = parts.select(*PAGE, F.lit(None).cast("long").alias("row"), F.array().cast("array<string>").alias("cells")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_pages(batches):
            starts = page_starts(rows)
            held = list(zip(*(rows.column(c).to_pylist() for c in (*order, "cx")), strict=True))
            grids = [_page_grid(held[i:j], most_columns) for i, j in pairwise([*starts.tolist(), len(held)])]
            sizes = [len(g) for g in grids]
            pages = rows.select(PAGE).take(pa.array(np.repeat(starts, sizes)))
            number = pa.array([k for n in sizes for k in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*pages.columns, number, pa.array([r for g in grids for r in g], pa.list_(pa.string()))], names=[*PAGE, "row", "cells"])

    return dealt.mapInArrow(run, shape)


def _bands(words: DataFrame, size: float, low: Column, high: Column) -> DataFrame:
    """Words once for each horizontal band of the page that low..high touches."""
    first, last = F.floor(low / size), F.floor(high / size)
    return words.withColumn("band", F.explode(F.sequence(first, last)))


def nearest_right(words: DataFrame, band: float = 64.0) -> DataFrame:
    """The word to the right of each word whose centre is within .8 of its height, at the smallest gap from 0 on.

    Words meet by bands of the page: one in the band of its centre, the other in all that its reach touches.
    """
    reach = 0.8 * F.col("height")
    a = _bands(words, band, F.col("cy") - reach, F.col("cy") + reach).select(*PAGE, "band", F.col("word_id").alias("a"), F.col("x2").alias("ax2"), F.col("cy").alias("acy"), F.col("height").alias("ah"))
    b = words.select(*PAGE, F.floor(F.col("cy") / band).alias("band"), F.col("word_id").alias("b"), F.col("x1").alias("bx1"), F.col("cy").alias("bcy"))
    near = a.join(b, [*PAGE, "band"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("acy") - F.col("bcy")) < 0.8 * F.col("ah")) & (F.col("bx1") >= F.col("ax2")))
    return near.groupBy(*PAGE, "a").agg(F.min_by("b", F.struct(F.col("bx1") - F.col("ax2"), "b")).alias("right"))


def overlaps(words: DataFrame, least: float = 0.4, band: float = 64.0) -> DataFrame:
    """Pairs of boxes of one page whose intersection over union is above ``least``. Boxes meet in the band of the page where the lower of their upper edges is."""
    from dossierlake.functions.scores import box_overlap

    cut = _bands(words, band, F.col("y1"), F.col("y2"))
    a = cut.select(*PAGE, "band", *[F.col(c).alias(f"a_{c}") for c in ("word_id", "x1", "y1", "x2", "y2")])
    b = cut.select(*PAGE, "band", *[F.col(c).alias(f"b_{c}") for c in ("word_id", "x1", "y1", "x2", "y2")])
    met = a.join(b, [*PAGE, "band"]).where("a_word_id < b_word_id").where(F.col("band") == F.floor(F.greatest("a_y1", "b_y1") / band))
    return met.withColumn("iou", F.round(box_overlap("a_", "b_"), 6)).where(F.col("iou") > least).select(*PAGE, F.col("a_word_id").alias("a"), F.col("b_word_id").alias("b"), "iou")


def key_values(rows: DataFrame) -> DataFrame:
    """Key and value of lines, cut at the first colon."""
    m = r"^([^:]*):(.*)$"
    return rows.where(F.contains("text", F.lit(":"))).select(*PAGE, "line", F.trim(F.regexp_extract("text", m, 1)).alias("key"), F.trim(F.regexp_extract("text", m, 2)).alias("value"))


def nearest_below(words: DataFrame, aside: float = 50.0) -> DataFrame:
    """The word below each word whose centre is less than ``aside`` to either side, at the smallest fall of centres. Words meet by vertical strips of the page."""
    near = words.select(*PAGE, F.explode(F.sequence(F.floor((F.col("cx") - aside) / aside), F.floor((F.col("cx") + aside) / aside))).alias("strip"), F.col("word_id").alias("a"), F.col("cx").alias("acx"), F.col("cy").alias("acy"))
    b = words.select(*PAGE, F.floor(F.col("cx") / aside).alias("strip"), F.col("word_id").alias("b"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"))
    met = near.join(b, [*PAGE, "strip"]).where((F.col("a") != F.col("b")) & (F.col("bcy") > F.col("acy")) & (F.abs(F.col("acx") - F.col("bcx")) < aside))
    return met.groupBy(*PAGE, "a").agg(F.min_by("b", F.struct(F.col("bcy") - F.col("acy"), "b")).alias("below"))


def label_values(words: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, page, label, value, strategy): candidates for the value of each word that holds a label.

    Candidates are the word to the right, the word below, the next two words to the right of that, and what is left
    of the word without the labels. A value that a page has shown before, going through labels in order and
    strategies in this one, isn't repeated.
    """
    text = words.select(*PAGE, "word_id", "text")
    right, below = nearest_right(words), nearest_below(words)
    hit = text.where(F.lower("text").rlike("|".join(labels))).select(*PAGE, F.col("word_id").alias("label_id"), F.col("text").alias("label"))
    hop = right.select(*PAGE, F.col("a").alias("at"), F.col("right").alias("next"))
    one = hit.join(hop, (hit["doc"] == hop["doc"]) & (hit["page"] == hop["page"]) & (hit["label_id"] == hop["at"]), "left").select(hit["*"], F.col("next").alias("r1"))
    for k in (1, 2):
        one = one.alias("o").join(hop.alias("h"), (F.col("o.doc") == F.col("h.doc")) & (F.col("o.page") == F.col("h.page")) & (F.col(f"o.r{k}") == F.col("h.at")), "left").select("o.*", F.col("h.next").alias(f"r{k + 1}"))
    under = below.select(*PAGE, F.col("a").alias("label_id"), "below")
    spread = one.join(under, [*PAGE, "label_id"], "left")
    places = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("strategy"), F.col(c).alias("word_id")) for i, (name, c) in enumerate((("nearest_right", "r1"), ("nearest_below", "below"), ("right_hop", "r2"), ("right_hop", "r3")))])
    linked = spread.select(*PAGE, "label_id", "label", F.inline(places)).where(F.col("word_id").isNotNull()).join(text, [*PAGE, "word_id"]).select(*PAGE, "label_id", "label", "step", "strategy", F.col("text").alias("value"))
    rest = F.regexp_replace(F.col("label"), "(?i)" + "|".join(labels), "")
    rest = F.regexp_replace(rest, r"^[ :/\-|]+|[ :/\-|]+$", "")
    inline = hit.select(*PAGE, "label_id", "label", F.lit(4).alias("step"), F.lit("inline").alias("strategy"), rest.alias("value")).where((F.col("value") != "") & (F.col("value") != F.trim("label")))
    first = Window.partitionBy(*PAGE, "value").orderBy("label_id", "step")
    return linked.unionByName(inline).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*PAGE, "label_id", "label", "value", "strategy")


def anchor_scores(words: DataFrame, anchors: DataFrame, reach: float = 500.0) -> DataFrame:
    """The best value of each anchor (doc, page, anchor_id, kind, text, x1, y1, x2, y2, line): (doc, page, anchor_id, word_id, score).

    Nearness gives up to 40 points, the same row or column 10 and its right or lower side 10 more, the same line 10,
    about the same height 10, and a percent sign beside a percentage 20. A page's few anchors meet its words.
    """
    mid = lambda p, a, b: (F.col(f"{p}{a}") + F.col(f"{p}{b}")) / 2
    a = anchors.select(*PAGE, "anchor_id", "kind", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", "line")]).withColumns({"a_cx": mid("a_", "x1", "x2"), "a_cy": mid("a_", "y1", "y2")})
    b = words.select(*PAGE, "word_id", "text", "x1", "y1", "x2", "y2", "line", mid("", "x1", "x2").alias("cx"), mid("", "y1", "y2").alias("cy"))
    dx, dy = F.abs(F.col("cx") - F.col("a_cx")), F.abs(F.col("cy") - F.col("a_cy"))
    far = F.sqrt(dx * dx + dy * dy)
    beside = F.when(dy < 20, 10 + F.when(F.col("x1") > F.col("a_x2"), 10).otherwise(0)).when(dx < 50, 10 + F.when(F.col("y1") > F.col("a_y2"), 10).otherwise(0)).otherwise(0)
    height = F.abs((F.col("y2") - F.col("y1")) - (F.col("a_y2") - F.col("a_y1"))) < 5
    score = F.when(far < reach, (1 - far / reach) * 40.0).otherwise(0.0) + beside + F.when(F.col("line") == F.col("a_line"), 10).otherwise(0) + F.when(height, 10).otherwise(0) + F.when((F.col("kind") == "PERCENTAGE") & F.contains("text", F.lit("%")), 20).otherwise(0)
    met = a.join(b, PAGE).where(F.col("word_id") != F.col("anchor_id")).withColumn("score", F.round(score, 6))
    return met.groupBy(*PAGE, "anchor_id").agg(F.max_by("word_id", F.struct("score", -F.col("word_id"))).alias("word_id"), F.max("score").alias("score"))


def wrapped_lines(rows: DataFrame, indent: float = 20.0) -> DataFrame:
    """Adds ``logical``: a line that is indented, overlaps the row above, follows it closely and is short or no further left joins that row.

    The row grows with each line that joins it; a fold over a page's lines keeps its extent and where rows begin.
    """
    held = F.array_sort(F.collect_list(F.struct("line", F.struct(*rows.columns).alias("row"))))
    pages = rows.groupBy(*PAGE).agg(held.alias("held"), F.min("x1").alias("margin"))
    falls = F.filter(F.transform("held", lambda h, i: F.when(i > 0, h["row"]["cy"] - F.get(F.col("held"), i - 1)["row"]["cy"])), lambda f: f > 0)
    pages = pages.withColumn("spacing", F.coalesce(median_of(falls), F.lit(15.0)))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("at"), none.alias("left"), none.alias("right"), none.alias("bottom"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, h: Column) -> Column:
        x = h["row"]
        joins = (x["x1"] > F.col("margin") + indent) & (x["x2"] >= s["left"]) & (x["x1"] <= s["right"]) & (x["y1"] - s["bottom"] < F.col("spacing") * 1.5) & ((x["tokens"] < 5) | (x["x1"] >= s["left"]))
        joins = F.coalesce(joins, F.lit(False))
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(joins, F.least(s["left"], x["x1"])).otherwise(x["x1"]).cast("double").alias("left"),
            F.when(joins, F.greatest(s["right"], x["x2"])).otherwise(x["x2"]).cast("double").alias("right"),
            F.when(joins, F.greatest(s["bottom"], x["y2"])).otherwise(x["y2"]).cast("double").alias("bottom"),
            F.when(joins | (s["at"] == 0), s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"]))).alias("starts"),
        )

    return _numbered(pages, F.aggregate("held", start, step)["starts"], "logical")


def positioned_text(words: DataFrame, least: float = 5.0, most: float = 15.0, usual: float = 8.0) -> DataFrame:
    """(doc, page, line, text): each line with its words at the columns where they stand.

    A column is the median width of a page's characters. Of words in one column the last from the left is shown, and
    a word covers the end of one that runs into it.
    """
    width = F.col("width") / F.length("text")
    char = F.coalesce(F.median(F.when(F.col("width") > 0, width)).over(Window.partitionBy(*PAGE)), F.lit(usual))
    x = words.withColumn("column", F.greatest(F.lit(0), F.floor(F.col("x1") / F.least(F.greatest(char, F.lit(least)), F.lit(most)))))
    slots = x.groupBy(*PAGE, "line", "column").agg(F.max_by("text", F.struct("x1", "word_id")).alias("text"))
    held = slots.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("slots"))
    written = F.aggregate("slots", F.lit(""), lambda line, s: F.concat(F.rpad(F.substr(line, F.lit(1), s["column"].cast("int")), s["column"].cast("int"), " "), s["text"], F.substr(line, (s["column"] + F.length(s["text"]) + 1).cast("int"))))
    return held.select(*PAGE, "line", F.rtrim(written).alias("text"))


#: Words of a header by the column's role, and what dates, amounts and references look like.
ROLES = {
    "date": ("date", "dated", "txn date", "value date", "post date", "trans date"),
    "description": ("description", "particulars", "narration", "details", "remarks", "transaction"),
    "debit": ("debit", "dr", "withdrawal", "dr.", "dr amount"),
    "credit": ("credit", "cr", "deposit", "cr.", "cr amount"),
    "balance": ("balance", "bal", "closing", "running balance"),
    "ref": ("ref", "chq", "reference", "cheque", "utr", "txn id", "txn ref"),
}
TX_DATE, TX_AMOUNT, TX_REF = r"\b[0-9]{2}[/\-][0-9]{2}[/\-][0-9]{2,4}\b|\b[0-9]{2}\s*[A-Za-z]{3}\s*[0-9]{2,4}\b", r"^[0-9][0-9,]*\.[0-9]{2}$", r"\b[A-Z0-9]{10,}\b"


def role(cell: Column) -> Column:
    """The role that a header's cell names, the first whose words it has."""
    low = F.lower(F.trim(cell))
    return F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), name) for name, words in ROLES.items()], F.lit("unknown"))


def _header_score(cells: Column) -> Column:
    def points(c: Column) -> Column:
        t = F.trim(c)
        return F.when(t == "", 0).otherwise(F.when(F.length(t) < 30, 1).otherwise(0) + F.when(F.replace(t, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$"), 2).otherwise(0) + F.when(role(t) != "unknown", 4).otherwise(0))

    return F.aggregate(F.transform(cells, points), F.lit(0), lambda a, x: a + x)


def _inferred(values: Column) -> Column:
    """The role of a column by its values: dates or amounts in more than half, references in more than .3."""
    some = F.greatest(F.size(F.filter(values, lambda x: F.trim(x) != "")), F.lit(1))
    share = lambda test: F.size(F.filter(values, test)) / some
    return F.when(share(lambda x: x.rlike(TX_DATE)) > 0.5, "date").when(share(lambda x: F.replace(x, F.lit(","), F.lit("")).rlike(TX_AMOUNT)) > 0.5, "amount").when(share(lambda x: x.rlike(TX_REF)) > 0.3, "ref").otherwise("description")


def transactions(grid: DataFrame) -> DataFrame:
    """(doc, page, row, date, description, amount, balance, ref) of the rows of a grid that have a date in their first 60 characters.

    The header is the likeliest of the first six rows, from three points on; its cells name the roles. Without one, or
    if it names none, roles come from the first twenty rows. Cells without a role go by what they look like. Of a
    row's amounts the last is the balance unless a column has it, and the one before it the amount.
    """
    scored = grid.withColumn("score", F.when(F.col("row") < 6, _header_score(F.col("cells"))).otherwise(0))
    best = scored.groupBy(*PAGE).agg(F.max(F.struct("score", (-F.col("row")).alias("up"), "cells")).alias("best"), F.array_sort(F.collect_list(F.when(F.col("row") < 20, F.struct("row", "cells")))).alias("first"), F.max(F.size("cells")).alias("columns"))
    named = F.when(F.col("best.score") >= 3, F.transform("best.cells", role))
    usable = named.isNotNull() & F.exists(named, lambda r: r != "unknown")
    columns = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda k: F.filter(F.transform("first", lambda r: F.get(r["cells"], k)), lambda c: c.isNotNull()))
    heads = best.select(*PAGE, F.when(usable, -F.col("best.up")).otherwise(-1).alias("header"), F.when(usable, named).otherwise(F.transform(columns, _inferred)).alias("roles"))
    rows = grid.join(heads, PAGE).where((F.col("row") > F.col("header")) & F.left(F.concat_ws(" ", "cells"), F.lit(60)).rlike(TX_DATE))
    cells = F.filter(F.zip_with(F.transform("cells", lambda c: F.trim(c)), "roles", lambda c, r: F.struct(c.alias("text"), r.alias("role"))), lambda x: (x["text"] != "") & x["role"].isNotNull())
    start = F.struct(*[F.lit("").alias(c) for c in ("date", "description", "balance", "ref")], F.array().cast("array<string>").alias("amounts"))

    def put(t: Column, x: Column) -> Column:
        text, kind = x["text"], x["role"]
        looks = F.when((t["date"] == "") & text.rlike(TX_DATE), "date").when(F.replace(text, F.lit(","), F.lit("")).rlike(TX_AMOUNT), "amount").when(F.length(text) > 4, "description")
        kind = F.when(kind == "unknown", looks).when(kind.isin("debit", "credit"), "amount").otherwise(kind)
        kind = F.coalesce(kind, F.lit("none"))
        return F.struct(
            F.when((kind == "date") & (t["date"] == ""), text).otherwise(t["date"]).alias("date"),
            F.when(kind == "description", F.trim(F.concat_ws(" ", t["description"], text))).otherwise(t["description"]).alias("description"),
            F.when(kind == "balance", text).otherwise(t["balance"]).alias("balance"),
            F.when(kind == "ref", text).otherwise(t["ref"]).alias("ref"),
            F.when(kind == "amount", F.concat(t["amounts"], F.array(text))).otherwise(t["amounts"]).alias("amounts"),
        )

    x = rows.select(*PAGE, "row", F.aggregate(cells, start, put).alias("t")).select(*PAGE, "row", "t.*")
    n = F.size("amounts")
    balance = F.when((F.col("balance") == "") & (n > 0), F.element_at("amounts", -1)).otherwise(F.col("balance"))
    amount = F.when(n >= 2, F.element_at("amounts", -2)).otherwise("")
    return x.where((F.col("date") != "") | (F.col("description") != "")).select(*PAGE, "row", "date", "description", amount.alias("amount"), balance.alias("balance"), "ref")


def labelled_rows(grid: DataFrame, least: int = 2) -> DataFrame:
    """(doc, page, row, label, value) of a grid whose first row fills half its columns, two at least: its cells are the labels of the others."""
    first = grid.where("row = 0").select(*PAGE, F.col("cells").alias("labels"))
    filled = F.size(F.filter("labels", lambda c: F.trim(c) != ""))
    sized = grid.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    heads = first.join(sized, PAGE, "left_semi").where(filled >= F.greatest(F.lit(2), F.floor(F.size("labels") * 0.5)))
    named = F.transform("labels", lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(F.trim(c)))
    rows = grid.where("row > 0").join(heads, PAGE).select(*PAGE, "row", F.posexplode(F.arrays_zip(named.alias("label"), F.col("cells").alias("value"))).alias("column", "cell"))
    return rows.select(*PAGE, "row", "column", F.col("cell.label").alias("label"), F.coalesce("cell.value", F.lit("")).alias("value"))


def column_gaps(words: DataFrame, width: int = 1000, least: int = 20) -> DataFrame:
    """(doc, page, column, x_left, x_right): columns of a page parted where no word stands for ``least`` pixels or more.

    Covered stretches are joined, so a gap is what lies between one's end and the next one's beginning; a smoothing of
    six pixels widens each stretch by two to the left and three to the right, and a separator is a gap's middle. A
    page without a gap is one column.
    """
    on = words.select(*PAGE, F.greatest(F.lit(0), F.floor("x1").cast("int")).alias("a"), F.least(F.lit(width), F.floor("x2").cast("int")).alias("b")).where("b > a").select(*PAGE, F.greatest(F.lit(0), F.col("a") - 2).alias("a"), F.least(F.lit(width), F.col("b") + 3).alias("b"))
    order = Window.partitionBy(*PAGE).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = on.withColumn("start", F.coalesce(reach + 1, F.lit(0))).where(F.col("a") - F.col("start") >= least).select(*PAGE, F.floor((F.col("start") + F.col("a")) / 2).cast("int").alias("cut"))
    end = on.groupBy(*PAGE).agg((F.max("b") + 1).alias("start")).where(F.lit(width + 1) - F.col("start") >= least).select(*PAGE, F.floor((F.col("start") + width + 1) / 2).cast("int").alias("cut"))
    cuts = gaps.unionByName(end).groupBy(*PAGE).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    pages = words.select(*PAGE).distinct().join(cuts, PAGE, "left")
    edges = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.lit(width)))
    many = F.size(F.coalesce("cuts", F.array().cast("array<int>"))) > 0
    spans = F.when(many, F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.struct(F.get(edges, k).alias("x_left"), F.get(edges, k + 1).alias("x_right")))).otherwise(F.array(F.struct(F.lit(0).alias("x_left"), F.lit(width).alias("x_right"))))
    return pages.select(*PAGE, F.posexplode(spans).alias("column", "span")).select(*PAGE, "column", "span.*")


def row_blocks(rows: DataFrame) -> DataFrame:
    """Lines with their block: those from the first to the last that has half the page's most words, two at least, are the table, the others its header and footer."""
    page = Window.partitionBy(*PAGE)
    wide = F.col("tokens") >= F.greatest(F.lit(2.0), F.max("tokens").over(page) * 0.5)
    x = rows.withColumn("_wide", wide)
    first, last = F.min(F.when(F.col("_wide"), F.col("line"))).over(page), F.max(F.when(F.col("_wide"), F.col("line"))).over(page)
    return x.withColumn("block", F.when(first.isNull() | (F.col("line") < first), "header").when(F.col("line") > last, "footer").otherwise("table")).drop("_wide")


def nearest_anchor(centre: Column, anchors: list[float]) -> Column:
    """The place of the anchor nearest to a centre, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(centre - a).alias("far"), F.lit(i).alias("i")) for i, a in enumerate(anchors)]))["i"]


def neighbours(words: DataFrame, aside: float = 50.0) -> DataFrame:
    """Each word and the next by number: whether they share a row or a column, and how far apart their centres are."""
    b = words.select(*PAGE, (F.col("word_id") - 1).alias("a"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("height").alias("bh"))
    x = words.select(*PAGE, F.col("word_id").alias("a"), "cx", "cy", "height").join(b, [*PAGE, "a"])
    dx, dy = F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    return x.select(*PAGE, "a", (F.abs(dy) < 0.5 * F.least("height", "bh")).alias("same_row"), (F.abs(dx) < aside).alias("same_column"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("distance"))


def reading_order(words: DataFrame) -> DataFrame:
    """Words by line, then from left to right."""
    return words.select(*PAGE, "word_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "x1", "word_id")).alias("place"))
