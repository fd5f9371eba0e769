"""Names, identity numbers and dates: normal forms and comparison."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From which score a name matches, or may match.
MATCH, POSSIBLE = 90, 75
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def without_accents(text: Column) -> Column:
    """Latin letters without the accents that Unicode composes with them."""
    return F.translate(text, _ACCENTED, _PLAIN)


def normal_name(name: Column) -> Column:
    """Latin letters without accents in lower case, single spaces between words."""
    plain = F.lower(without_accents(F.coalesce(name, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z\s]", " "), r"\s+", " "))


def normal_id(number: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), r"[\s\-]", ""))


def normal_dob(dob: Column) -> Column:
    """DD/MM/YYYY where it is a full date, anything else trimmed."""
    raw = F.trim(F.coalesce(dob, F.lit("")))
    return F.when(raw.rlike(r"^\d{2}[/-]\d{2}[/-]\d{4}$"), F.translate(raw, "-", "/")).otherwise(raw)


def sound(word: Column) -> Column:
    """A four-character code of a word: its first letter, then the codes of the consonants after it, none twice running.

    Vowels neither count nor part equal codes, the first letter has no code, and Y counts as 2.
    """
    up = F.upper(F.trim(word))
    # Fixed value: the code of each consonant.
    codes = F.translate(F.regexp_replace(F.substr(up, F.lit(2)), "[^BCDFGJKLMNPQRSTVXYZ]", ""), "BFPVCGJKQSXYZDTLMNR", "1111222222222334556")
    squeezed = F.regexp_replace(codes, r"(\d)\1+", "$1")
    return F.when(up == "", "").otherwise(F.rpad(F.concat(F.substring(up, 1, 1), F.substring(squeezed, 1, 3)), 4, "0"))


def phonetic(a: Column, b: Column) -> Column:
    """Percent of the words of a that sound like any word of b, of the longer name's words."""
    wa, wb = F.filter(F.split(a, " "), lambda x: x != ""), F.filter(F.split(b, " "), lambda x: x != "")
    codes = F.transform(wb, sound)
    hits = F.size(F.filter(F.transform(wa, sound), lambda x: F.array_contains(codes, x)))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(hits / F.greatest(F.size(wa), F.size(wb), F.lit(1)) * 100.0)


def word_difference(a: Column, b: Column) -> Column:
    """Words that only one of the names has, in order."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    return F.array_sort(F.array_union(F.array_except(wa, wb), F.array_except(wb, wa)))


def indel_ratio(a: str, b: str) -> float:
    """Percent similarity by insertions and deletions: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter name against any stretch of its length of the longer, or of the ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    ends = [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    return max(indel_ratio(short, x) for x in [long[i : i + n] for i in range(len(long) - n + 1)] + ends)


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    return max(indel_ratio(left, right), *([indel_ratio(both, left), indel_ratio(both, right)] if both else [0.0]))


def fuzzy_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    return max(indel_ratio(a, b), indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), _token_set(a, b), _partial(a, b))


def _each_pair(score, a: pd.Series, b: pd.Series) -> pd.Series:
    """The score of each pair; equal pairs of a batch are scored once."""
    pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
    place, distinct = pd.factorize(pairs)
    return pd.Series([score(x, y) for x, y in distinct], dtype="float64").take(place).reset_index(drop=True)


@F.pandas_udf(T.DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The better of the plain ratio and that of the words in order."""
    return _each_pair(lambda x, y: max(indel_ratio(x, y), indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split())))) if x and y else 0.0, a, b)


@F.pandas_udf(T.DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best of the plain, sorted-word, shared-word and partial ratios."""
    return _each_pair(fuzzy_score, a, b)


def name_score(a: Column, b: Column) -> Column:
    """Fuzzy score of two normal names, raised to .95 of the phonetic score where that is 75 or more and the first no match."""
    score, heard = fuzzy(a, b), phonetic(a, b)
    return F.when((heard >= 75) & (score < MATCH), F.greatest(score, heard * 0.95)).otherwise(score)


def name_status(score: Column) -> Column:
    return F.when(score >= MATCH, "MATCH").when(score >= POSSIBLE, "POSSIBLE_MATCH").otherwise("MISMATCH")


def id_status(stored: Column, found: Column) -> Column:
    """Equal numbers match; the tier for confused characters can't be reached, as it compares no more than this."""
    a, b = normal_id(stored), normal_id(found)
    return F.when((a == "") | (b == ""), "MISMATCH").when(a == b, "MATCH").otherwise("MISMATCH")


def dob_status(stored: Column, found: Column) -> Column:
    """Equal dates match; a year alone that agrees may."""
    a, b = normal_dob(stored), normal_dob(found)
    year = (F.right(a, F.lit(4)) == F.right(b, F.lit(4))) & ((F.length(a) == 4) | (F.length(b) == 4))
    return F.when((a == "") | (b == ""), "MISMATCH").when(a == b, "MATCH").when(year, "POSSIBLE_MATCH").otherwise("MISMATCH")


