"""Token counts by the whole-token shortcut.

Once, on the driver, every string of the vocabulary is encoded alone; those that give one token are proven whole
tokens. Texts are then cut into pre-tokens, the proven ones count one each, and only the rest is merged, each
distinct pre-token once a process.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dossierlake.llm._tokenizer import load, special_strings

#: Fixed value: how the byte-level vocabulary of the file cuts a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on whose class this module's Unicode tables and the library's may differ; what is around one goes to the library.
_DOUBTED = "\u0558-\u1fff\u2070-\u2fff\u3100-\u4dff\u9fa6-\uabff\ud7a4-\U0010ffff"
UNSURE = re.compile(f"[{_DOUBTED}]")
#: A single blank between two other characters of known class: a pre-token begins there, whatever stands further on.
CUT = re.compile(rf"(?<=[^\s{_DOUBTED}]) (?=[^\s{_DOUBTED}])")
#: Merged pre-tokens that a process remembers.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 128
#: Pre-tokens that are held at once of one text.
HELD = 100_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


@lru_cache(maxsize=4)
def whole_tokens(tokenizer: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and that encode alone as one token."""
    t, code = load(tokenizer), _byte_alphabet()
    found = []
    for token in t.get_vocab(with_added_tokens=False):
        try:
            text = bytes(code[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if (m := PRE_TOKEN.match(text)) and m.end() == len(text):
            found.append(text)
    return frozenset(x for x, e in zip(found, t.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class _Counts(dict):
    """Tokens of each pre-token: one for the proven, merged by the library for the rest."""

    def __init__(self, tokenizer: str, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.tokenizer = proven, load(tokenizer)

    def __missing__(self, pre_token: str) -> int:
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self.library(pre_token)
        if len(pre_token) < REMEMBERED_CHARS:
            self[pre_token] = n
        return n

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


_process: dict[str, _Counts] = {}


def count_tokens(text: str, counts: _Counts, special: list[str]) -> int:
    if any(s in text for s in special):
        return counts.library(text)
    if text.isascii() or not UNSURE.search(text):
        return _count(text, counts)
    cuts, n, at = [m.start() for m in CUT.finditer(text)], 0, 0
    while m := UNSURE.search(text, at):
        k = bisect_right(cuts, m.start())
        low, high = max(at, cuts[k - 1] if k else 0), cuts[k] if k < len(cuts) else len(text)
        n += _count(text[at:low], counts) + (counts[text[low:high]] if high - low < REMEMBERED_CHARS else counts.library(text[low:high]))
        at = high
    return n + _count(text[at:], counts)


def _count(text: str, counts: _Counts) -> int:
    if len(text) < HELD:
        return sum(map(counts.__getitem__, PRE_TOKEN.findall(text)))
    n, found = 0, PRE_TOKEN.finditer(text)
    while part := [counts[m.group()] for m in islice(found, HELD)]:
        n += sum(part)
    return n


def with_token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts equal the library's with its defaults and without added begin or end tokens. A text that holds the string
    of a special token goes to the library whole; of one with characters of blocks that Unicode still extends, only
    the part around these, to the next single blank between others. A null text counts as empty: no bytes, no tokens. Null, tied and repeated ids are kept as they are, one row for each row; an empty table gives an empty table; other
    columns are not read. Texts of any length are counted whole; of one text a bounded number of pre-tokens is held.
    ``tokenizer`` is a path or the name of an installed file, and is needed on every executor.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _process.get(tokenizer)
        if counts is None:
            counts = _process[tokenizer] = _Counts(tokenizer, proven.value)
        special = special_strings(counts.tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = [count_tokens(x.as_py(), counts, special) for x in texts]
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col], docs[text]).mapInArrow(run, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
