"""Suggested corrections of extracted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.functions.text import title_case

#: The fixes in the order in which they are tried.
FIXES = ("unicode_cleanup", "merged_word_fix", "punctuation_cleanup", "spacing_fix", "capitalization_fix")
#: A fix counts if it raises the similarity by more than this; a possible match of at least that score takes the stored value.
GAIN, NEAR = 3, 85


def without_marks(value: Column) -> Column:
    """Letters without their accents: Latin letters that Unicode composes, and marks that follow a letter."""
    return F.regexp_replace(nm.without_accents(value), r"\p{Mn}", "")


def fixed(value: Column) -> tuple[Column, Column]:
    """The value after all fixes in their order, and the names of those that changed it."""
    steps = [value]
    steps.append(without_marks(steps[-1]))
    steps.append(F.regexp_replace(steps[-1], "([a-z])([A-Z])", "$1 $2"))
    steps.append(F.trim(F.regexp_replace(F.trim(F.regexp_replace(steps[-1], r"[^\p{L}\p{N}_\s/\-]", "")), r"\s+", " ")))
    steps.append(F.trim(F.regexp_replace(steps[-1], r"\s+", " ")))
    steps.append(title_case(steps[-1]))
    applied = F.array_compact(F.array(*[F.when(a != b, name) for a, b, name in zip(steps, steps[1:], FIXES, strict=False)]))
    return steps[-1], applied


def same(a: Column, b: Column) -> Column:
    """100 for values that are equal but for case, else 0: the comparison without a fuzzy library."""
    return F.when((a != "") & (b != "") & (F.lower(a) == F.lower(b)), 100.0).otherwise(0.0)


def suggestion(stored: Column, extracted: Column, status: Column, score: Column, similarity=nm.sorted_ratio) -> Column:
    """A struct of suggested_value, correction_type, auto_fixable and confidence_after.

    A match needs nothing and a missing value a person; else the fixed value is suggested where it is clearly nearer
    to the stored one, and the stored one where the values nearly agree.
    """
    value, applied = fixed(extracted)
    after = similarity(F.coalesce(stored, F.lit("")), value)
    better = after > score + GAIN
    nearly = (status == "POSSIBLE_MATCH") & (score >= NEAR)
    missing = F.coalesce(extracted, F.lit("")) == ""

    def rule(matched, absent, mended, near, other) -> Column:
        return F.when(status == "MATCH", matched).when(missing, absent).when(better, mended).when(nearly, near).otherwise(other)

    none = F.lit(None).cast("string")
    return F.struct(
        rule(extracted, none, value, stored, none).alias("suggested_value"),
        rule(F.lit("no_correction"), F.lit("manual_required"), F.coalesce(F.get(applied, F.lit(0)), F.lit("spacing_fix")), F.lit("ocr_typo_fix"), F.lit("manual_required")).alias("correction_type"),
        rule(F.lit(False), F.lit(False), F.lit(True), F.lit(True), F.lit(False)).alias("auto_fixable"),
        rule(F.lit(100), F.lit(0), after.cast("int"), F.lit(97), score.cast("int")).alias("confidence_after"),
    )
