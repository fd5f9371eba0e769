"""Fields, kinds and subject rows read from the text of identity and academic documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.text import title_case

#: How twelve-digit numbers are written, in the order in which they are tried.
TWELVE = (r"\b([0-9]{4}[\s\-][0-9]{4}[\s\-][0-9]{4})\b", r"\b([0-9]{4}[\s\-][0-9]{8}|[0-9]{8}[\s\-][0-9]{4})\b", r"(?m)^[\s]*?([0-9]{12})[\s]*?$")
#: Dates of birth: with a label, in full, a labelled year, and with a short year.
BORN = (r"(?i)(?:DOB|Date\s+of\s+Birth|D\.O\.B)[^0-9]*([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4})", r"\b([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4})\b", r"(?i)(?:Year\s+of\s+Birth|YOB)[^0-9]*([0-9]{4})", r"\b([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{2})\b")
#: Fields that any identity document may show.
KYC = {
    "name": r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    "aadhaar_number": r"\b([0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4})\b",
    "pan_number": r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",
    "dob": r"\b([0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}|[0-9]{2}\s+\w{3}\s+[0-9]{4})\b",
    "phone": r"\b([6-9][0-9]{9})\b",
    "address": r"(?is)(?:Address|Addr)[:\s]+(.{10,200}?)(?:\n{2,}|$)",
}
#: Words that name the kind of an identity document, the first kind that has one.
KYC_KINDS = (
    ("aadhaar", ("aadhaar", "unique identification", "uid")),
    ("pan", ("permanent account", " pan ", "income tax")),
    ("passport", ("passport", "republic of india", "passport no")),
    ("driving_license", ("driving licence", "driving license", "dl no")),
    ("bank_statement", ("account statement", "statement of account", "bank statement")),
)
#: Readings of the two genders.
GENDERS = {"Male": ("male", "mele", "maie", "mae", "m"), "Female": ("female", "femal", "femafe", "f")}
#: Phrases that settle the kind of an academic document, the first that occurs, and weighted signals.
SETTLED = (("degree", r"statement\s+of\s+grades?"), ("degree", r"\bsgpa\b.*\bcgpa\b|\bcgpa\b.*\bsgpa\b"), ("ssc", r"secondary\s+school\s+certificate"), ("hsc", r"higher\s+secondary\s+certificate"))
SIGNALS = {
    "ssc": (
        (10, r"\bssc\b"),
        (10, r"secondary\s+school\s+certificate"),
        (8, r"\bclass\s+(x|10|10th)\b"),
        (6, r"\b10th\b"),
        (4, r"higher\s+secondary\s+examination"),
        (5, r"\bmarch[- ]\s*20[0-9]{2}\b"),
        (3, r"\bseat\s+no\b"),
        (3, r"\bschool\s+no\b"),
        (3, r"\bcertificate\s+no\b"),
        (4, r"state\s+board"),
        (6, r"\bmatriculation\b"),
        (4, r"\bicse\b"),
        (4, r"\bcbse\b"),
        (2, r"total\s+marks"),
        (2, r"obtained\s+marks"),
        (2, r"division"),
        (2, r"distinction"),
        (2, r"mother'?s?\s+name"),
    ),
    "hsc": (
        (10, r"\bhsc\b"),
        (10, r"higher\s+secondary\s+certificate"),
        (8, r"\bclass\s+(xii|12|12th)\b"),
        (6, r"\b12th\b"),
        (4, r"\bscience\b"),
        (4, r"\bcommerce\b"),
        (3, r"\barts\b"),
        (4, r"\bstream\b"),
        (4, r"junior\s+college"),
        (5, r"\bfyjc\b|\bsyjc\b"),
        (6, r"higher\s+secondary"),
        (5, r"\bintermediate\b"),
        (3, r"state\s+board"),
        (3, r"\bicse\b"),
        (3, r"\bcbse\b"),
        (2, r"total\s+marks"),
        (2, r"mother'?s?\s+name"),
    ),
    "degree": (
        (10, r"\bsgpa\b"),
        (10, r"\bcgpa\b"),
        (8, r"\bsemester\b"),
        (8, r"\bsem[\s\-.]\s*[iivx0-9]+\b"),
        (10, r"statement\s+of\s+grades?"),
        (8, r"\btranscript\b"),
        (6, r"\buniversity\b"),
        (8, r"\bprn\b"),
        (4, r"\brollno\b|\broll\s+no\b"),
        (8, r"\b(b\.?tech|b\.?sc|b\.?com|b\.?e\.?|b\.?a\.?|m\.?tech|m\.?sc|mba|bca|mca)\b"),
        (6, r"\bbachelor\b|\bmaster\b"),
        (6, r"aggregate\s+(percentage|marks)"),
        (5, r"credit\s+(hours?|points?)"),
        (5, r"\bgrade\s+point\b"),
        (5, r"\bresult\s+class\b"),
        (8, r"consolidated\s+marksheet"),
        (3, r"\btoppers?\b"),
        (3, r"first\s+class\b"),
        (3, r"distinction\s+with"),
    ),
}
#: Words of school subjects, marks and grades in a line.
SUBJECT = (
    r"(?i)mathematics?|maths?|science|physics|chemistry|biology|life\s+science|english|hindi|marathi|gujarati|urdu|tamil|telugu|kannada|bengali|punjabi"
    r"|social\s+science|history|geography|civics|economics|computer\s+science|information\s+technology|accounts?|accountancy|commerce|business\s+studies"
    r"|environment|evs|art|drawing|craft|physical\s+education|sports|vocational|sanskrit|french|german|spanish"
)
MARKS = r"\b([0-9]{1,3})(?:\s*/\s*([0-9]{2,3}))?\b"
GRADE = r"\b([OAABCDFPE]{1,2}\+?)\b"
GRADE_NAMES = {"O": "Outstanding", "A+": "Excellent", "A": "Very Good", "B+": "Good", "B": "Above Average", "C": "Average", "D": "Pass", "F": "Fail", "P": "Pass", "AB": "Absent", "E": "Excellent"}
#: Words of addresses, and short words of English, which no name has; parts of names of two letters.
ADDRESS = r"(?i)\b(village|dist|district|state|pin|post|tehsil|mandal|taluk|taluka|near|landmark|ward|nagar|colony|sector|block|road|street|mohalla|flat|house|plot|s/o|d/o|w/o|c/o|at|po|ps|via)\b"
NO_START = r"(?i)^(gn|mn|dn|tn|rn|fn|vn|bn|pn|ng|nr|nl|nk|wr([^i]|$)|ch([^aeiou]|$)|gh([^aeiou]|$)|[bcdfghjklmnpqrstvwxyz]{3})"
NO_NAMES = (
    "to", "of", "in", "by", "an", "at", "on", "or", "as", "is", "it", "if", "no", "up", "do", "go", "so", "us", "we", "he", "me", "my", "any", "the", "and",
    "for", "not", "but", "can", "was", "are", "did", "had", "has", "may", "too", "see", "get", "use", "say", "put", "end", "his", "her", "him", "she", "our",
    "its", "now", "new", "old", "big", "all", "one", "two", "yes", "yet", "also", "well", "than", "with", "this", "that", "they", "from", "have", "been",
    "what", "when", "your", "some", "just", "will", "more", "very", "much", "only", "even", "both", "such", "then", "into", "over", "back", "here", "made",
    "take", "time", "like", "good", "know", "look", "make", "come", "give", "most", "need", "else", "away", "down", "each", "many", "next", "same", "said",
    "once", "tell", "want", "went", "were", "whom",
)
SHORT_NAMES = (
    "al", "el", "de", "du", "la", "le", "mc", "st", "da", "di", "do", "ma", "ra", "sa", "ka", "ta", "na", "pa", "va", "ba", "om", "sk", "rk", "ak", "pk", "ed",
    "ad", "bo",
)
#: Lines of a card that are no names.
NO_NAME_LINES = (
    r"(?i)\b(income|tax|department|government|india|permanent|account|number|pan|signature|dob|date|birth|father|holder|individual|company|firm|huf|trust|name)\b",
    r"[0-9]{4,}",
    r"[/@\\|<>{}]",
    r"(?i)^(of|the|and|or|in|at|to|a|an|is)\s",
)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def twelve_digits(text: Column) -> Column:
    """A twelve-digit number in fours, by the first of three ways of writing it and then by a line of its own; numbers that begin like a year or have a group of zeros aren't taken."""

    def sound(raw: Column) -> Column:
        digits = F.regexp_replace(raw, r"[\s\-]", "")
        groups = [F.substring(digits, i, 4) for i in (1, 5, 9)]
        year = groups[0].try_cast("int").between(1800, 2099)
        return F.when((F.length(digits) == 12) & ~year & ~reduce(lambda a, b: a | b, [g == "0000" for g in groups]), F.concat_ws(" ", *groups))

    alone = F.filter(F.transform(_lines(text), lambda x: F.regexp_replace(x, r"[\s\-]", "")), lambda x: x.rlike("^[0-9]{12}$"))
    return F.coalesce(*[sound(_first(text, p)) for p in TWELVE], F.get(F.filter(F.transform(alone, sound), lambda x: x.isNotNull()), F.lit(0)))


def born(text: Column) -> Column:
    """A date of birth as DD/MM/YYYY, or a year that is labelled as one; a short year up to 25 is of this century."""
    label, full, year, short = (_first(text, p) for p in BORN)
    cut = F.translate(short, "-.", "//")
    y = F.right(cut, F.lit(2)).cast("int")
    return F.coalesce(F.translate(label, "-.", "//"), F.translate(full, "-.", "//"), year, F.concat(F.left(cut, F.lit(6)), (y + F.when(y <= 25, 2000).otherwise(1900)).cast("string")))


def full_date(raw: Column) -> Column:
    """DD/MM/YYYY of a date by itself with misread digits, null unless it is plausible."""
    t = F.translate(F.trim(raw), "lIiOoSsZzBgq", "111005522899")
    long, short = r"^([0-9]{2})[/\-.]([0-9]{2})[/\-.]([0-9]{4})$", r"^([0-9]{2})[/\-.]([0-9]{2})[/\-.]([0-9]{2})$"
    day, month = F.left(t, F.lit(2)), F.substring(t, 4, 2)
    dated = day.try_cast("int").between(1, 31) & month.try_cast("int").between(1, 12)
    y = F.right(t, F.lit(2)).try_cast("int")
    year = F.when(t.rlike(long), F.right(t, F.lit(4))).when(t.rlike(short), (y + F.when(y <= 25, 2000).otherwise(1900)).cast("string"))
    return F.when(dated & year.try_cast("int").between(1900, 2025), F.concat_ws("/", day, month, year))


def plausible_date(date: Column) -> Column:
    """Whether a date of birth is a plausible year or full date."""
    year = F.when(date.rlike("^[0-9]{4}$"), date.try_cast("int").between(1900, 2025))
    full = date.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & F.left(date, F.lit(2)).try_cast("int").between(1, 31) & F.substring(date, 4, 2).try_cast("int").between(1, 12) & F.right(date, F.lit(4)).try_cast("int").between(1900, 2025)
    return F.coalesce(year, full, F.lit(False))


def gender(raw: Column) -> Column:
    low = F.trim(F.lower(raw))
    return F.coalesce(*[F.when(low.isin(*words), name) for name, words in GENDERS.items()])


def kyc_fields(text: Column) -> dict[str, Column]:
    """The fields of an identity document, each by its first match; numbers without blanks, an address in one line."""
    out = {name: _first(text, p) for name, p in KYC.items()}
    out["aadhaar_number"] = F.regexp_replace(out["aadhaar_number"], r"[\s\-]", "")
    out["address"] = F.replace(F.regexp_replace(out["address"], r"^\s+|\s+$", ""), F.lit("\n"), F.lit(", "))
    return out


def kyc_kind(text: Column) -> Column:
    low = F.lower(text)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.coalesce(*[F.when(has(words), kind) for kind, words in KYC_KINDS], F.lit("unknown"))


def academic_kind(text: Column) -> Column:
    """A struct of document_type and confidence of an academic document: settled by a phrase, else the highest sum of signals of at least five, and sure by its lead over the next."""
    low = F.lower(text)
    settled = F.coalesce(*[F.when(low.rlike("(?U)" + p), kind) for kind, p in SETTLED])
    sums = {k: sum((F.when(low.rlike("(?U)" + p), w).otherwise(0) for w, p in signals), F.lit(0)) for k, signals in SIGNALS.items()}
    ranked = F.sort_array(F.array(*[F.struct(x.alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, (k, x) in enumerate(sums.items())]), asc=False)

    def judged(r: Column) -> Column:
        top, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        lead = F.round(F.least(F.lit(30.0) + (top["score"] - second["score"]) / F.nullif(top["score"], F.lit(0)) * 70.0, F.lit(99.0)) + 1e-9, 1)
        weak = top["score"] < 5
        return F.struct(F.when(weak, "unknown").otherwise(top["kind"]).alias("document_type"), F.when(weak, 0.0).otherwise(lead).alias("confidence"))

    # Ranked inside a function of arrays, so that all signals are looked for once.
    scored = F.get(F.transform(F.array(ranked), judged), F.lit(0))
    fixed = lambda kind, sure: F.struct(kind.alias("document_type"), F.lit(sure).alias("confidence"))
    short = F.coalesce(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(0)) < 30
    return F.when(short, fixed(F.lit("unknown"), 0.0)).otherwise(F.get(F.transform(F.array(settled), lambda k: F.when(k.isNotNull(), fixed(k, 95.0)).otherwise(scored)), F.lit(0)))


def _grade_name(grade: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in GRADE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.upper(F.trim(grade))), F.trim(grade))


def table_row(line: Column) -> Column:
    """A struct of subject, marks_obtained, marks_total and grade of a line of cells; no subject unless it has one and a number."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\|+|\t+|\s{3,}"), lambda x: F.trim(x)), lambda x: x != "")
    numeric = lambda x: x.rlike(r"^[0-9]+(?:\.[0-9]+)?$")
    numbers = F.transform(F.filter(cells, numeric), lambda x: x.cast("double"))
    subjects = F.filter(cells, lambda x: ~numeric(x) & x.rlike(SUBJECT))
    grades = F.filter(cells, lambda x: ~numeric(x) & ~x.rlike(SUBJECT) & x.rlike(f"^(?:{GRADE})$"))
    fits = (F.size(cells) >= 2) & (F.size(subjects) > 0) & (F.size(numbers) > 0)
    return F.struct(F.when(fits, title_case(F.element_at(subjects, -1))).alias("subject"), F.get(numbers, F.lit(0)).alias("marks_obtained"), F.get(numbers, F.lit(1)).alias("marks_total"), F.when(F.size(grades) > 0, _grade_name(F.element_at(grades, -1))).alias("grade"))


def text_row(line: Column) -> Column:
    """The same struct of a line of text with a subject's word and marks of at most 200."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    found = F.transform(F.regexp_extract_all(trimmed, F.lit(MARKS), 0), lambda m: F.struct(F.regexp_extract(m, "^([0-9]+)", 1).cast("double").alias("got"), F.regexp_extract(m, r"/\s*([0-9]+)$", 1).try_cast("double").alias("of")))
    usable = F.filter(found, lambda m: m["got"] <= 200)
    got, of = F.get(usable, F.lit(0))["got"], F.get(F.filter(usable, lambda m: m["of"].isNotNull()), F.lit(0))["of"]
    grade = _first(trimmed, GRADE)
    fits = (F.length(trimmed) >= 4) & trimmed.rlike(SUBJECT) & got.isNotNull()
    return F.struct(F.when(fits, title_case(F.regexp_extract(trimmed, f"({SUBJECT})", 1))).alias("subject"), got.alias("marks_obtained"), of.alias("marks_total"), F.when(grade != "OF", _grade_name(grade)).alias("grade"))


def human_name(candidate: Column) -> Column:
    """Whether a line can be a person's name: letters alone, up to five words, none of an address, none that can't be part of a name."""
    name = F.regexp_replace(candidate, r"^\s+|\s+$", "")
    words = F.split(name, r"\s+")

    def part(w: Column) -> Column:
        low = F.lower(w)
        longer = ~w.rlike(NO_START) & ((F.length(w) < 4) | low.rlike("[aeiou]")) & ~low.isin(*NO_NAMES) & ((F.length(w) != 2) | low.isin(*SHORT_NAMES))
        return ~w.rlike(r"[.,;:!?]$") & F.when(F.length(w) == 1, w.rlike("[A-Za-z]")).otherwise(longer)

    return F.coalesce(F.length(name).between(4, 50) & name.rlike(r"^[A-Za-z\s.\-']+$") & F.size(words).between(1, 5) & ~name.rlike(ADDRESS) & F.forall(words, part), F.lit(False))


def name_line(line: Column) -> Column:
    """Whether a line of a card can be its holder's name: two to five words, letters for the most part, no label."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    letters = lambda x: F.regexp_count(x, F.lit(r"\p{L}"))
    bad = reduce(lambda a, b: a | b, [s.rlike(p) for p in NO_NAME_LINES])
    each = F.forall(words, lambda w: (F.length(w) == 1) | (letters(w) / F.length(w) >= 0.7))
    return F.coalesce((F.length(s) >= 4) & ~bad & (letters(s) / F.greatest(F.length(s), F.lit(1)) >= 0.88) & F.size(words).between(2, 5) & each, F.lit(False))


def label_score(text: Column, label: Column) -> Column:
    """How far a line shows a label: 1 where it holds it, else by its words (.6) and by shared pairs of letters (.4)."""
    t, lb = F.trim(F.lower(text)), F.trim(F.lower(label))
    clean = lambda x: F.regexp_replace(x, r"[^a-z\x{0900}-\x{097f}\s]", " ")
    split = lambda x: F.filter(F.split(clean(x), r"\s+"), lambda w: w != "")
    words, there = split(lb), split(t)
    hits = F.size(F.filter(words, lambda w: F.exists(there, lambda x: F.contains(x, w))))

    def pairs(x: Column) -> Column:
        s = F.replace(clean(x), F.lit(" "), F.lit(""))
        n = F.length(s)
        return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))

    a, b = pairs(t), pairs(lb)
    shared = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).otherwise(0.0)
    whole = F.when((lb == "name") & ~t.rlike(r"\bname\b"), 0.0).otherwise(1.0)
    score = F.when(F.size(words) > 0, hits / F.greatest(F.size(words), F.lit(1)) * 0.6 + shared * 0.4).otherwise(0.0)
    return F.when((t == "") | (lb == ""), 0.0).when(F.contains(t, lb), whole).otherwise(score)


def label_match(line: Column, labels: list[str]) -> Column:
    """1 for a line that holds a label, .8 for one that has .6 of its words, else 0, by the first label that fits."""
    there = F.split(F.lower(line), r"\s+")
    rules = []
    for label in labels:
        words = F.array_distinct(F.array(*[F.lit(w) for w in label.lower().split()]))
        rules.append(F.when(F.contains(F.lower(line), F.lit(label.lower())), 1.0).when(F.size(F.array_intersect(words, there)) / F.size(words) >= 0.6, 0.8))
    return F.coalesce(*rules, F.lit(0.0))


def unwrapped(value: Column) -> Column:
    """The plain text of a field that may be a JSON object with a value; empty ones are null."""
    s = F.trim(value)
    whole = F.try_parse_json(s) if hasattr(F, "try_parse_json") else F.lit(None)
    inner = F.when(s.startswith("{") & whole.isNotNull(), F.get_json_object(s, "$.value"))
    has = F.when(s.startswith("{"), F.array_contains(F.json_object_keys(s), "value"))
    plain = F.when(F.coalesce(has, F.lit(False)), F.trim(F.coalesce(inner, F.lit("None")))).otherwise(s)
    return F.nullif(plain, F.lit(""))


def field_state(original: Column, read: Column, kind: str) -> Column:
    """empty, invalid, system_extracted, matched or needs_review of a value that was given and one that was read."""

    def norm(x: Column) -> Column:
        s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\n\r\t\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]", ""), " +", " "))
        return {"name": F.lower(s), "aadhaar": F.regexp_replace(s, "[^0-9]", ""), "pan": F.replace(F.upper(s), F.lit(" "), F.lit(""))}.get(kind, s)

    o, e = norm(original), norm(read)
    return F.when((o == "") & (e == ""), "empty").when(e == "", "invalid").when(o == "", "system_extracted").when(o == e, "matched").otherwise("needs_review")


def record_state(states: list[Column], final: Column, workflow: Column, verified: Column) -> Column:
    """The state of a record: a final one, else the most urgent of its fields'."""
    has = lambda x: F.array_contains(F.array(*states), x)
    done = F.coalesce(final, F.lit(False)) | (F.upper(F.coalesce(workflow, F.lit(""))).isin("VERIFIED", "APPROVED") & F.coalesce(verified, F.lit(False)))
    every = reduce(lambda a, b: a & b, [s == "matched" for s in states])
    return F.when(done, "matched").when(has("needs_review"), "needs_review").when(has("invalid"), "invalid").when(has("system_extracted"), "system_extracted").when(every, "matched").otherwise("system_extracted")
