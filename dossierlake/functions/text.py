"""Numbers, dates and features read from free text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of identity numbers and codes.
PATTERNS = {
    "has_12digit": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "has_pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "has_gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    "has_ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "has_mrz": r"[A-Z<]{9,}",
}
#: What a format adds to the score of a type, the most that a score can be, and the least that names a type.
BOOSTS = {"aadhaar": ("has_12digit", 0.20), "pan": ("has_pan", 0.25), "invoice": ("has_gstin", 0.20), "bank_statement": ("has_ifsc", 0.15), "passport": ("has_mrz", 0.30)}
LEAST, MOST = 0.08, 0.95
#: Weighted patterns of each document type, (weight, pattern), in the syntax and sense of Python's ``re``.
SIGNATURES = {
    "aadhaar": (
        (0.4, r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
        (0.25, r"\bXXXX\s?XXXX\s?\d{4}\b"),
        (0.15, r"(?i)\b(aadhaar|आधार|uid|uidai|unique\s*identification)\b"),
        (0.1, r"(?i)\b(dob|date\s+of\s+birth|जन्म\s*तिथि)\b"),
        (0.1, r"(?i)\b(address|पता|s/o|d/o|w/o|c/o)\b"),
    ),
    "pan": (
        (0.45, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
        (0.2, r"(?i)\b(permanent\s*account|income\s*tax|pan\s*card|आयकर)\b"),
        (0.15, r"(?i)\b(father|father\'s\s*name|पिता|s/o)\b"),
        (0.1, r"(?i)\b(dob|date\s+of\s+birth)\b"),
        (0.1, r"(?i)\b(government\s+of\s+india|भारत\s+सरकार|income\s+tax\s+department)\b"),
    ),
    "bank_statement": (
        (0.2, r"(?i)\b(a/?c|account\s*no|acc\s*no)[\s:]+\d{8,18}\b"),
        (0.25, r"(?i)\b(dr|cr|debit|credit|neft|rtgs|imps|upi|atm)\b"),
        (0.2, r"[₹]\s*[\d,]+\.?\d{0,2}"),
        (0.15, r"(?i)\b(balance|closing|opening|available)\b"),
        (0.1, r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+[\d,.]+"),
        (0.1, r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ),
    "invoice": (
        (0.3, r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"),
        (0.2, r"(?i)\b(invoice|bill|receipt|challan|tax\s*invoice|proforma)\b"),
        (0.15, r"(?i)\b(gst|cgst|sgst|igst|hsn|sac)\b"),
        (0.15, r"(?i)\b(total|grand\s+total|subtotal|amount\s+due|net\s+amount)\b"),
        (0.1, r"(?i)\b(qty|quantity|unit|price|rate|discount)\b"),
        (0.1, r"(?i)(tax|%)[\s:]+[\d,.]+"),
    ),
    "marksheet": (
        (0.25, r"(?i)\b(marks|score|grade|gpa|cgpa|percentage|pass|fail)\b"),
        (0.2, r"(?i)\b(subject|paper|theory|practical|total\s+marks)\b"),
        (0.2, r"(?i)\b(result|declaration|exam|examination|university|board)\b"),
        (0.15, r"(?i)\b(roll\s*(no|number)|enrollment|reg(istration)?\s*(no|number))\b"),
        (0.1, r"\d{2,3}\s*/\s*\d{2,3}"),
        (0.1, r"(?i)\b(first|second|third)\s+division\b"),
    ),
    "ration_card": (
        (0.35, r"(?i)\b(ration|राशन|fair\s+price|ration\s+card|bpl|apl)\b"),
        (0.2, r"(?i)\b(head\s+of\s+family|परिवार\s+के\s+मुखिया|family\s+member)\b"),
        (0.15, r"(?i)\b(fair\s+price\s+shop|fps|ration\s+shop|dealer)\b"),
        (0.15, r"(?i)\b(state\s+government|राज्य\s+सरकार|district|tehsil|taluka)\b"),
        (0.15, r"(?i)\b(wheat|rice|sugar|kerosene|dal|गेहूं|चावल|चीनी)\b"),
    ),
    "government_doc": (
        (0.25, r"(?i)\b(government\s+of|ministry|department\s+of|official|gazette|notification)\b"),
        (0.15, r"(?i)\b(seal|stamp|office\s+of|under\s+secretary|section\s+officer)\b"),
        (0.15, r"(?i)\b(order|circular|memorandum|letter|no\.)\s+\d"),
        (0.2, r"(?i)\b(collector|magistrate|tehsildar|officer|director|commissioner)\b"),
        (0.15, r"(?i)\b(ref\.?\s*no|file\s*no|dated|subject)\b"),
        (0.1, r"(?i)\b(to\s+whomsoever|this\s+is\s+to\s+certify|certified\s+that)\b"),
    ),
    "passport": (
        (0.25, r"(?i)\b(passport|travel\s+document|republic\s+of\s+india)\b"),
        (0.35, r"[A-Z<]{9,}"),
        (0.15, r"(?i)\b(nationality|ind|indian)\b"),
        (0.1, r"(?i)\b(visa|entry|departure|immigration)\b"),
        (0.15, r"(?i)\b(valid\s+until|expiry|expires|date\s+of\s+issue)\b"),
    ),
}
#: Formats that raise the score of a type beside its patterns.
FORMATS = {t: (PATTERNS[f], x) for t, (f, x) in BOOSTS.items()}
#: Multiplication and permutation of the check digit scheme over five-sided rotations.
_TIMES = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
_TURN = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _permutations() -> list[list[int]]:
    out = [list(range(10))]
    while len(out) < 8:
        out.append([_TURN[d] for d in out[-1]])
    return out


def check_digit_holds(number: Column) -> Column:
    """Whether a number of digits alone passes the dihedral check, folded from its right end."""
    digits = F.reverse(F.split(number, ""))
    times = F.array(*[F.lit(x) for row in _TIMES for x in row])
    turn = F.array(*[F.lit(x) for row in _permutations() for x in row])
    coded = F.transform(digits, lambda d, i: F.get(turn, (i % 8) * 10 + d.cast("int")))
    return F.when(number.rlike("^[0-9]+$"), F.aggregate(coded, F.lit(0), lambda c, d: F.get(times, c * 10 + d)) == 0).otherwise(False)


_LINE_END = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Fixed value: a line that names a field before a colon.
FIELD = r"[A-Za-z\x{0900}-\x{097F}][^:]+:\s*\S"


def _share(text: Column, characters: str) -> Column:
    """The share of characters of a class; counted by leaving runs of them out."""
    n = F.char_length(text)
    return (n - F.char_length(F.regexp_replace(text, f"[{characters}]+", ""))) / F.greatest(n, F.lit(1))


def _fields(text: Column) -> Column:
    """How many fields a text names. Only what stands before its last colon, and the next character, can be of one, so the pattern never runs on to the end in vain."""
    tail = F.substring_index(text, ":", -1)
    body = F.concat(F.left(text, F.char_length(text) - F.char_length(tail)), F.when(tail.rlike(r"\S"), "x").otherwise(""))
    return F.when(F.contains(text, F.lit(":")), F.regexp_count(body, F.lit(FIELD))).otherwise(0)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Fixed value: characters of rows of numbers.
NUMERIC = r"0-9,.₹/\- "


def _line_counts(text: Column) -> Column:
    """A struct of lines that aren't blank and of those among them that are numeric for more than half.

    Numeric characters are taken out of the whole text at once, and its lines then compared in length with what is left of them.
    """
    lines, rest = F.split(text, _LINE_END), F.split(F.regexp_replace(text, f"[{NUMERIC}]+", ""), _LINE_END)
    kept = F.filter(F.arrays_zip(lines.alias("line"), rest.alias("rest")), lambda x: x["line"].rlike(r"\S"))
    numeric = lambda x: 2 * F.char_length(x["rest"]) < F.char_length(x["line"])
    return once(kept, lambda k: F.struct(F.size(k).alias("all"), F.size(F.filter(k, numeric)).alias("numeric")))


def feature_row(text: Column) -> Column:
    """A struct of counts and shares of words, lines, scripts, digits, fields and rows of numbers, and which formats occur."""

    def made(x: Column) -> Column:
        t, n = x["text"], F.greatest(x["lines"]["all"], F.lit(1))
        out = {
            "word_count": F.regexp_count(t, F.lit(r"\S+")),
            "line_count": x["lines"]["all"],
            "devanagari_ratio": F.round(F.when(t.rlike(r"[\x{0900}-\x{097F}]"), F.regexp_count(t, F.lit(r"[\x{0900}-\x{097F}]")) / F.greatest(F.char_length(t), F.lit(1))).otherwise(0.0), 3),
            "latin_ratio": F.round(_share(t, "A-Za-z"), 3),
            "numeric_ratio": F.round(_share(t, "0-9"), 3),
            "currency_present": t.rlike("[₹$€£]"),
            "has_currency_amounts": F.contains(t, F.lit("₹")) & t.rlike(r"₹\s*[0-9,]+"),
            "field_pattern_density": F.round(_fields(t) / n, 3),
            "numeric_row_density": F.round(x["lines"]["numeric"] / n, 3),
        }
        digit = t.rlike("[0-9]")
        out |= {k: t.rlike(p) if k == "has_mrz" else digit & t.rlike(p) for k, p in PATTERNS.items()}
        return F.struct(*[v.alias(k) for k, v in out.items()])

    return once(F.struct(text.alias("text"), _line_counts(text).alias("lines")), made)


def needed(pattern: str) -> list[str]:
    """Strings of which every match of a pattern has one, none if that can't be told: the longest plain run of each alternative of its first group, or of the pattern."""
    body = pattern.removeprefix("(?i)").removeprefix(r"\b")
    if m := re.match(r"\(([^()?](?:[^()]|\([^()]*\))*)\)(?![?*])", body):
        body = m[1]
    parts, depth, part = [], 0, ""
    for token in re.findall(r"\\.|.", body):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append(part)
            part = ""
        else:
            part += token
    out = []
    for part in [*parts, part]:
        plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]?|\[[^\]]*\](?:[?*+]|\{[^}]*\})?", "\0", part)  # groups and classes
        plain = re.sub(r"(?:\\?[^\\])[?*]", "\0", plain)  # what may be absent
        plain = re.sub(r"\\([^A-Za-z0-9])", lambda m: m[1], re.sub(r"\\[A-Za-z](?:\+|\{[^}]*\})?", "\0", plain))
        run = max(re.split(r"[\0+{}^$]", plain), key=len)
        if not run:
            return []
        out.append(run)
    # One that holds another adds nothing.
    return [x for x in dict.fromkeys(out) if not any(y != x and y in x for y in out)]


def needs_digit(pattern: str) -> bool:
    """Whether every match of a pattern has a digit, as one stands outside its groups and other classes and isn't optional."""
    body = re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern.removeprefix("(?i)").replace("[0-9]", r"\d"))
    return bool(re.search(r"\\d(?!\{0|[?*])", re.sub(r"\[[^\]]*\]", "", body)))


def _occurs(t: Column, pattern: str) -> Column:
    """Whether a pattern of Python's ``re`` occurs in ``t``, a struct of text, low, ascii and digit, with classes of all of Unicode.

    One that ignores case is looked for in the lower-cased text. Before the pattern, a plain string that it needs is
    looked for, or a digit; and a text of ASCII alone doesn't need classes of all of Unicode, which are slow.
    """
    own, p = (t["low"], pattern.removeprefix("(?i)")) if pattern.startswith("(?i)") else (t["text"], pattern)
    found = F.when(t["ascii"], own.rlike(p)).otherwise(own.rlike("(?U)" + p))
    if pattern.startswith("(?i)") and (strings := needed(pattern)):
        guard = F.contains(own, F.lit(strings[0]))
        for x in strings[1:]:
            guard = guard | F.contains(own, F.lit(x))
        found = guard & found
    return (t["digit"] & found) if needs_digit(pattern) else found


def signature_type(text: Column, table_density: Column | None = None, hint: Column | None = None) -> Column:
    """The type of the highest score over all eight, the first of equals; unknown below the least score.

    A score is the sum of the weights of the type's patterns that occur and of what formats, tables, scripts and the
    hint add. ``table_density`` is the share of blocks that are tables.
    """

    def judged(t: Column) -> Column:
        scores = {}
        for kind, patterns in SIGNATURES.items():
            found = F.lit(0.0)
            for weight, pattern in patterns:
                found = found + F.when(_occurs(t, pattern), weight).otherwise(0.0)
            scores[kind] = F.least(F.lit(MOST), found / max(sum(x for x, _ in patterns), 1.0))

        def add(kind: str, when: Column, points: float) -> None:
            scores[kind] = F.least(F.lit(MOST), scores[kind] + F.when(when, points).otherwise(0.0))

        for kind, (pattern, points) in FORMATS.items():
            add(kind, _occurs(t, pattern), points)
        if table_density is not None:
            lines = F.filter(F.split(t["text"], _LINE_END), lambda x: x.rlike(r"(?U)[^\s]"))
            numbers = F.filter(lines, lambda x: _share(x, NUMERIC) > 0.5)
            numeric = F.round(F.size(numbers) / F.greatest(F.size(lines), F.lit(1)), 3) > 0.3
            tabular = F.coalesce((F.round(table_density, 3) > 0.4) & numeric, F.lit(False))
            add("bank_statement", tabular, 0.10)
            add("marksheet", tabular, 0.08)
        devanagari = ~t["ascii"] & (F.round(F.regexp_count(t["text"], F.lit("[\u0900-\u097F]")) / F.greatest(F.char_length(t["text"]), F.lit(1)), 3) > 0.30)
        add("ration_card", devanagari, 0.08)
        add("government_doc", devanagari, 0.05)
        if hint is not None:
            for kind in SIGNATURES:
                add(kind, F.coalesce(hint == kind, F.lit(False)), 0.10)
        return F.array_max(F.array(*[F.struct(x.alias("score"), F.lit(-k).alias("place"), F.lit(kind).alias("type")) for k, (kind, x) in enumerate(scores.items())]))

    ascii_ = F.octet_length(text) == F.char_length(text)
    read = F.struct(text.alias("text"), F.lower(text).alias("low"), ascii_.alias("ascii"), F.when(ascii_, text.rlike("[0-9]")).otherwise(text.rlike(r"(?U)\d")).alias("digit"))
    return once(once(read, judged), lambda b: F.when(b["score"] >= LEAST, b["type"]).otherwise("unknown"))


def first_match(text: Column, *patterns: str) -> Column:
    """What the first pattern that occurs finds, null if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in patterns])


def grouped_digits(number: Column) -> Column:
    """Twelve digits in fours; anything else as it is."""
    return F.regexp_replace(number, r"^(\d{4})(\d{4})(\d{4})$", "$1 $2 $3")


def masked(number: Column) -> Column:
    return F.concat(F.lit("XXXX XXXX "), F.right(number, F.lit(4)))


def four_digit_year(year: Column) -> Column:
    """Two digits up to 25 are of this century, others of the last."""
    y = year.cast("int")
    return F.when(y >= 100, y).when(y <= 25, y + 2000).otherwise(y + 1900)


def plausible_dob(day: Column, month: Column, year: Column) -> Column:
    return day.between(1, 31) & month.between(1, 12) & year.between(1900, 2025)


def repaired_digits(text: Column) -> Column:
    """Letters that are read for digits, turned back."""
    return F.translate(text, "OoQDIlisSBZ", "00001115582")


def title_case(text: Column) -> Column:
    """A capital after anything that isn't a letter, the rest small."""
    marked = F.regexp_replace(F.lower(text), r"([^a-z]|^)([a-z])", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


#: Letters that ``upper`` spells out although they have a capital of one letter, sharp s and Greek letters with an iota below, and these capitals.
_SPELT = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c)
_CAPITALS = "ẞ" + "".join(c.title() for c in _SPELT[1:])


def capitals(text: Column) -> Column:
    """Each letter as its capital of one letter, as it is if it has none; ``upper`` makes several of some."""
    up = F.upper(text)
    one = lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, _SPELT, _CAPITALS))
    return F.when(F.char_length(up) == F.char_length(text), up).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))
