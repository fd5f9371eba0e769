"""Personal data: base patterns, and terms that reveal a protected entity.

The base finds e-mail addresses, IP addresses, card and telephone numbers. The information-theoretic part then
asks which other terms give such an entity away. Over the whole corpus, ``n(e)`` documents hold entity e, ``n(t)``
hold term t and ``n(t, e)`` hold t near e. The information that t gives on e is PMI = log2(N n(t,e) / (n(t) n(e)));
as a share of all the information in e, log2(N / n(e)), it is 0 where t says nothing and 1 where t occurs with e
alone. A term whose share passes a threshold, and that stands near the entity at least ``support`` times, in one
document or in several and whatever else stands there, is disclosed: at ``generalise`` it is replaced by its kind, at ``remove`` it goes, wherever it stands in
any text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import LOWER, NOT_ALNUM, U64, Words, hash_spans, text_slices
from dossierlake.llm._scratch import Scratch
from dossierlake.llm._sieve import passing, sieve

#: The kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns, written so that a long run of their characters is passed over once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
#: Words on each side of an entity that count as near it.
NEAR_WORDS = 10


def _emails(text: str) -> list[tuple[int, int]]:
    """A match ends its local part at ``@``, so it begins where the run of local characters before that does."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, end := m.end()))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in the order in which spans are listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _hash_texts(texts: list[str]) -> np.ndarray:
    raw = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return hash_spans(data, np.concatenate([[0], ends[:-1]]), ends)


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int, int, list]]]:
    """Entities of a text, and (entity, term, times, spans of the term) for each term near an entity.

    ``times`` counts the places of the entity that have the term near. Spans are those of terms that an entity cuts off from a longer word; all others are found by ``occurrences``.
    """
    names, around = [], []
    words = [m.span() for m in WORD.finditer(text)]
    opens, closes = [a for a, _ in words], [b for _, b in words]
    starts, furthest = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max, initial=0))
    for start, kind, end in spans:
        value = text[start:end]
        names.append(f"{KINDS[kind]}:{_digits(value) if kind > 1 else value.lower()}")
        before, after = bisect_left(opens, start), bisect_right(closes, end)  # words that begin before and end after
        near = [(a, min(b, start)) for a, b in words[max(0, before - NEAR_WORDS) : before]]
        near += [(max(a, end), b) for a, b in words[after : after + NEAR_WORDS]]
        around.append([(a, b) for a, b in near if furthest[bisect_left(starts, b)] <= a])  # no part of a span
    entities = _hash_texts(names).view(np.int64).tolist()
    flat = [text[a:b] for words in around for a, b in words]
    hashes = _hash_texts(flat) if flat else np.zeros(0, U64)
    found: dict[tuple[int, int], list] = {}
    at = 0
    for entity, words in zip(entities, around, strict=True):
        terms = hashes[at : at + len(words)]
        at += len(words)
        for term in set(terms.view(np.int64).tolist()):
            found.setdefault((entity, term), [0, []])[0] += 1
        for term, span in zip(terms.view(np.int64).tolist(), words, strict=True):
            if WORD.match(text, max(0, span[0] - 1), span[0]) or WORD.match(text, span[1], span[1] + 1):
                found[entity, term][1].append(span)
    return sorted(set(entities)), [(e, t, n, sorted(set(s))) for (e, t), (n, s) in found.items()]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_NEAR = T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.LongType()), T.StructField("times", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN))])
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_ARROW_NEAR = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("times", pa.int64()), ("spans", pa.list_(_ARROW_SPAN))])


def _scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Base spans of each row, its entities and the terms near them; ``row`` names the row within the written table."""
    fields = [T.StructField("row", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("near", T.ArrayType(_NEAR))]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, entities, near = [], [], []
            for x in pc.fill_null(batch.column(1), ""):
                spans = base_spans(body := x.as_py())
                names, terms = near_terms(body, spans) if spans else ([], [])
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                entities.append(names)
                near.append([{"entity": e, "term": t, "times": times, "spans": [{"start": a, "kind": 4, "end": b} for a, b in s]} for e, t, times, s in terms])
            n = batch.num_rows
            columns = [pa.array(np.arange(row, row + n)), batch.column(0), pa.array(base, pa.list_(_ARROW_SPAN)), pa.array(entities, pa.list_(pa.int64())), pa.array(near, pa.list_(_ARROW_NEAR))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=schema.names)
            row += n

    return docs.select(docs[id_col], docs[text]).mapInArrow(run, schema)


def term_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the number of documents that hold each term, over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets, NOT_ALNUM, LOWER)
                order = np.lexsort((words.text_of, words.hash))
                h, t = words.hash[order], words.text_of[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                parts.append(h[first])
            terms, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])

    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
    return docs.select(docs[text]).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, term, span) of every word of the whole texts that may be one of ``terms``, but those in base spans."""
    shared = rows.sparkSession.sparkContext.broadcast(sieve(terms, "term"))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets, NOT_ALNUM, LOWER)
                hit = passing(shared.value, words.hash)
                if not len(hit):
                    continue
                # Code points before each byte, as every byte but those that continue one begins one.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                own = words.text_of[hit]
                start, end = (points[x[hit]] - points[offsets[own]] for x in (words.start, words.end))
                keep = np.ones(len(hit), bool)
                for k in np.unique(own):
                    here = slice(*np.searchsorted(own, (k, k + 1)))
                    for span in batch.column(1)[a + int(k)].as_py():
                        keep[here] &= (start[here] >= span["end"]) | (end[here] <= span["start"])
                row = batch.column(0).take(pa.array(a + own[keep]))
                span = pa.StructArray.from_arrays([pa.array(start[keep]), pa.array(np.full(keep.sum(), 4, np.int32)), pa.array(end[keep])], fields=list(_ARROW_SPAN))
                yield pa.RecordBatch.from_arrays([row, pa.array(words.hash[hit[keep]].view(np.int64)), span], names=["row", "term", "span"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("term", T.LongType()), T.StructField("span", _SPAN)])
    return rows.select("row", "base", "text").mapInArrow(run, schema)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", generalise: float = 0.6, remove: float = 0.9, support: int = 2, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, base and spans, arrays of (start, kind, end) in code points, end exclusive.

    ``kind`` is a place in ``KINDS``. ``base`` has what the patterns find; ``spans`` has these and the disclosed
    terms wherever they stand in any text, by start and kind; ``removed`` has the disclosed terms that go altogether. A term
    that stands near an entity fewer than ``support`` times in all isn't disclosed by it; 1 lets the share alone
    decide. With ``with_text`` the text
    comes along. A null text counts as empty. Null, tied and repeated ids are rows of their own; an empty table
    gives an empty table; other columns are not read. Every text is read whole.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = scratch.keep(_scan(docs, id_col, text), "rows")
    total = F.lit(float(rows.count()))
    entities = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    near = rows.select("row", F.inline("near"))
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.sum("times").alias("times")).where(F.col("times") >= support)
    measured = pairs.join(entities, "entity").join(term_documents(rows), "term")
    share = F.log2(total * F.col("n_both") / (F.col("n") * F.col("n_entity"))) / F.log2(total / F.col("n_entity"))
    disclosed = measured.withColumn("share", F.when(total > F.col("n_entity"), share)).where(F.col("share") >= generalise)
    disclosed = scratch.keep(disclosed.groupBy("term").agg((F.max("share") >= remove).alias("goes")), "disclosed")
    cut_off = near.where(F.size("spans") > 0).select("row", "term", F.explode("spans").alias("span"))
    found = occurrences(rows, disclosed).unionByName(cut_off).join(disclosed, "term")
    added = found.groupBy("row").agg(F.collect_set("span").alias("terms"), F.collect_set(F.when(F.col("goes"), F.col("span"))).alias("removed"))
    none = F.array().cast(T.ArrayType(_SPAN))
    out = rows.drop("entities", "near", *["text"] * (not with_text)).join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("terms", none)))
    return out.select(id_col, "base", spans.alias("spans"), F.coalesce("removed", none).alias("removed"), *["text"] * with_text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id_col and ``sanitised``: the text with base spans and generalised terms replaced by their kind in brackets, and removed terms taken out."""
    found = find_spans(docs, id_col, text, with_text=True, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans, removed in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "removed")), strict=True):
                gone, parts, end = {(x["start"], x["end"]) for x in removed}, [], 0
                body = body or ""
                for x in spans:
                    if x["end"] <= end:
                        continue
                    parts.append(body[end : max(end, x["start"])])
                    parts.append("" if x["kind"] == 4 and (x["start"], x["end"]) in gone else f"[{KINDS[x['kind']].upper()}]")
                    end = x["end"]
                out.append("".join([*parts, body[end:]]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.string())], names=[id_col, "sanitised"])

    return found.mapInArrow(run, T.StructType([found.schema[id_col], T.StructField("sanitised", T.StringType())]))


def _listed(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _number(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == F.lit(kind))).cast("long")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_number("base", k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
