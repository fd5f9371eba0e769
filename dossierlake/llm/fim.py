"""Fill-in-the-middle by lines: a tokenizers Split with isolated matches gives the units and their code-point offsets.

No tokenizer is trained or loaded: the pre-tokenizer alone cuts a text into units and says where each ends. The
number of ends is n, and two hashed ranks among them are the cuts between prefix, middle and suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A unit is a line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of output that a task holds before it hands them on.
HELD_CHARS = 4 << 20


@lru_cache(maxsize=4)
def _split(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated")


def unit_ends(text: str, pattern: str = LINES) -> list[int]:
    """Where each unit of the text ends, in code points."""
    return [end for _, (_, end) in _split(pattern).pre_tokenize_str(text)] if text else []


def rearrange(text: str, ends: list[int], hashes: tuple[int, int, int, int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, prefix_chars, middle_chars, output) of a text whose units end at ``ends``."""
    h1, h2, h3, h4 = hashes
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    bounds = [0, *ends]
    low, high = sorted((h1 % len(bounds), h2 % len(bounds)))
    a, b = bounds[low], bounds[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of. Texts with a mark are plain, so the first mark of each kind is the operator's."""
    first, last = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.locate(MIDDLE, output)
    at = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    size = F.char_length(first)
    one = F.substring(output, F.lit(len(PREFIX) + 1), at - (len(PREFIX) + 1))
    two = F.substring(output, at + size, last - at - size)
    middle = F.substring(output, last + len(MIDDLE), F.lit(2147483647))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def _hashes(seed: int, doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, pattern: str = LINES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n, form, prefix_chars, middle_chars, output.

    Of 100 texts about ``rate`` are rearranged, ``spm`` of 100 of these with the suffix first. ``output`` is the whole
    new text, and ``restore`` gives the old one back.

    A null text counts as empty and stays plain, as does one that holds a mark. A row without an id is hashed as if
    its id were written with no digit. Repeated rows and tied ids are rows of their own, with the same cuts where
    texts are equal; an empty table gives an empty table; a text is never cut short; other columns are not read.
    """
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"), *_hashes(seed, docs[id_col]))
    own = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, kind) for c, kind in own]])

    def batch_of(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
        n, form, prefix, middle, output = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held, first = [], 0, 0
            hashes = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            for i, (x, h) in enumerate(zip(batch.column(1), hashes, strict=True)):
                whole = x.as_py()
                ends = unit_ends(whole, pattern)
                made.append((len(ends), *rearrange(whole, ends, h, rate, spm)))
                held += len(whole)
                if held > HELD_CHARS:
                    yield batch_of(batch.column(0)[first : i + 1], made)
                    made, held, first = [], 0, i + 1
            if made:
                yield batch_of(batch.column(0)[first:], made)

    return source.mapInArrow(run, schema)


def op13_fim(spark, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of every whole text of ``documents``."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
k AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(units) + 1) AS b,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 100 AS plain,
    ('0x' || d[25:32])::BIGINT % 100 < 50 AS spm FROM h),
c AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(units[greatest(a, b) + 1:], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c"""
