"""License scans: Aho-Corasick over whole texts, and a shunting-yard parser for license expressions.

One automaton goes over the words of a text, written with one blank between them, and finds every place of every
notice phrase. Another goes over the text itself and finds identifier tags; the expression behind a tag is brought
into postfix order by a shunting-yard and evaluated to how strict its terms are: ``or`` leaves the choice of the
milder, ``and`` asks for the stricter, ``with`` an exception takes the terms of the licence down a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import LOWER, NOT_ALNUM

#: Fixed values of the contract: base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further phrases; words as a text has them once punctuation is taken for blanks.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Steps of strictness, from none to terms that forbid whole uses.
STEPS = (0.1, 0.25, 0.5, 0.75, 1.0)
#: The step of each label; a label that isn't listed has that of ``UNKNOWN``.
STRICT = {
    "cc0": 0, "unlicense": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2,
    "gpl": 3, "cc-by-sa": 3,
    "agpl": 4, "cc-by-nc": 4, "cc-by-nc-nd": 4, "cc-by-nc-sa": 4, "cc-by-nd": 4, "reserved": 4,
}
UNKNOWN = 2
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_VERSION = re.compile(r"-v?\d.*")
#: Bytes of words: letters of A-Z lowered, all that isn't in a word a blank.
WORDS = bytes(32 if NOT_ALNUM[b] else b for b in LOWER.tolist())
LOWERED = LOWER.tobytes()


class Terms(NamedTuple):
    """What an expression comes to: its step of strictness, and the labels that it names."""

    step: int
    labels: frozenset[str]


def label_of(identifier: str) -> str:
    """The licence that an identifier is a version of: ``GPL-2.0-or-later`` is of ``gpl``."""
    return _VERSION.sub("", identifier.lower().removesuffix("+"))


def postfix(text: str) -> list[str]:
    """Shunting-yard: the longest expression at the start of ``text``, operators after their operands.

    Operators are read in any case; ``with`` binds closest, then ``and``, then ``or``, all from the left. What can't go
    on an expression ends it, as do the end of a line and any other character; an operator or a bracket
    without its other side is dropped from the end. Empty if no expression stands there.
    """
    tokens, at = [], 0
    while m := TOKEN.match(text, at):
        tokens.append(m[1] or m[2])
        at = m.end()
    tokens = tokens[: _longest(tokens)]
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        word = token.lower()
        if word in BINDS:
            while waiting and BINDS.get(waiting[-1], 0) >= BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(token)
    return out + waiting[::-1]


def _longest(tokens: list[str]) -> int:
    """How many of the tokens make the longest whole expression."""
    whole, depth, operand, after_with = 0, 0, False, False
    for i, token in enumerate(tokens):
        word = token.lower()
        if word in BINDS:
            if not operand or (word == "with" and (tokens[i - 1] == ")" or (i > 1 and tokens[i - 2].lower() == "with"))):
                break  # an exception is to one licence
            operand, after_with = False, word == "with"
        elif token == "(":
            if operand or after_with:
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif operand:
            break
        else:
            operand, after_with = True, False
        if operand and not depth:
            whole = i + 1
    return whole


def evaluate(ordered: list[str]) -> Terms | None:
    """The terms of an expression in postfix order; None of an empty one."""
    held: list[Terms] = []
    for token in ordered:
        if token not in BINDS:
            label = label_of(token)
            held.append(Terms(STRICT.get(label, UNKNOWN), frozenset((label,))))
            continue
        b, a = held.pop(), held.pop()
        if token == "with":
            held.append(Terms(max(0, a.step - 1), a.labels))
        else:
            held.append(Terms((min if token == "or" else max)(a.step, b.step), a.labels | b.labels))
    return held[0] if held else None


@lru_cache(maxsize=8)
def _automaton(strings: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for s in strings:
        out.add_word(s, s)
    out.make_automaton()
    return out


def find_notices(text: bytes, phrases: tuple[str, ...]) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (first word, phrase) of every place, overlapping ones too, by where they end."""
    words = text.translate(WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "  # a character per byte
    found, at, before = [], 0, 0
    for end, padded in _automaton(tuple(f" {p} " for p in phrases)).iter(line):
        before += line.count(" ", at, end + 1)
        at = end + 1
        phrase = padded[1:-1]
        found.append((before - 2 - phrase.count(" "), phrase))
    return len(words), found


def find_tags(text: bytes, tags: tuple[str, ...] = TAGS) -> list[tuple[int, list[str]]]:
    """(byte at which an expression's tag begins, the expression in postfix order) of every tag that has one."""
    lowered = text.translate(LOWERED)
    if not any(t.encode() in lowered for t in tags):
        return []
    out = []
    for end, tag in _automaton(tags).iter(lowered.decode("latin-1")):
        stop = text.find(b"\n", end)
        if ordered := postfix(text[end + 1 : stop if stop >= 0 else len(text)].decode("latin-1")):
            out.append((end + 1 - len(tag), ordered))
    return out


_PLACES = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("phrase", T.StringType())]), False)
_TAGS = T.ArrayType(T.StructType([T.StructField("byte", T.LongType()), T.StructField("postfix", T.StringType()), T.StructField("strictness", T.DoubleType())]), False)


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, places, tags, labels, score.

    ``places`` has every place of a phrase by its first word; ``tags`` the byte of each identifier tag that has an
    expression, this in postfix order, and its strictness. ``labels``, ordered and distinct, are those of all phrases
    and of all identifiers in expressions, whose exceptions give none. All that a text states holds together, so
    ``score`` is the strictness of its strictest notice or expression, and 0 without any.

    A null text counts as empty: no words, no places, score 0. Null, tied and repeated ids are kept, a row for each
    row; an empty table gives an empty table; whole texts are read, however long; other columns are not read.
    """
    phrases = base | notices
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", _PLACES), T.StructField("tags", _TAGS), T.StructField("labels", T.ArrayType(T.StringType(), False)), T.StructField("score", T.DoubleType())])

    def one(whole: bytes) -> tuple:
        n, found = find_notices(whole, tuple(phrases))
        read = [(at, ordered, evaluate(ordered)) for at, ordered in find_tags(whole, tags)]
        labels = {phrases[p] for _, p in found}.union(*(terms.labels for *_, terms in read))
        steps = [STRICT.get(phrases[p], UNKNOWN) for _, p in found] + [terms.step for *_, terms in read]
        places = [{"word": w, "phrase": p} for w, p in sorted(found)]
        return n, places, [{"byte": at, "postfix": " ".join(x), "strictness": STEPS[terms.step]} for at, x, terms in read], sorted(labels), STEPS[max(steps)] if steps else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            columns = zip(*(one(x.as_py()) for x in texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=schema.names)

    return docs.select(docs[id_col], docs[text]).mapInArrow(run, schema)


def _labels(places: Column, of: dict[str, str]) -> Column:
    named = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(places, lambda x: named[x["phrase"]])))


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """Places, labels and strictness of every whole text of ``documents``."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.withColumn("base", F.filter("places", lambda x: x["phrase"].isin(list(BASE))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(_labels(F.col("base"), BASE), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
