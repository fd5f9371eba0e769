"""Names on cards and sheets by where they stand: lines after a label, below a number, between two anchors, or by form alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions import parsers as ps
from dossierlake.functions.text import title_case

# Labels of names, of fathers and of dates of birth on a tax card.
NAME_LABEL = r"(?iU)[/|\\]\s*Name\b|^\s*Name\s*$"
FATHER_LABEL = r"(?iU)[/|\\]\s*Father|\bFather'?s?\s+Name\b|\bs[/]o\b|\bd[/]o\b|\bw[/]o\b"
BIRTH_LABEL = r"(?iU)[/|\\]\s*Date\s+of\s+Birth|[/|\\]\s*DOB\b|\bDate\s+of\s+Birth\b"
# The head of an identity card, and what parts a name from the fields behind it on one line.
HEAD = r"(?i)government of india|govt of india|uidai|unique identification authority"
BIRTH_LINE = r"(?iU)\bdob\b|\bdate\s+of\s+birth\b|\byear\s+of\s+birth\b"
FIELD_PARTS = r"(?iU)\b(?:dob|date\s+of\s+birth|year\s+of\s+birth|d\.o\.b|male|female|other|[0-9]{2}[/\-.:][0-9]{2}[/\-.:][0-9]{2,4}|[0-9]{4})\b"
# Words of sheets that no candidate's name has.
ACADEMIC_NOISE = (
    "board", "university", "college", "institute", "school", "marksheet", "certificate", "examination", "result", "class",
    "roll", "seat", "prn", "enrol", "index", "reg", "register", "mother", "father", "guardian", "address", "date", "birth",
    "standard", "stream", "division", "medium", "year", "session", "subject", "marks", "total", "percentage", "grade",
    "pass", "fail", "sr", "no", "number", "form", "secondary", "higher", "statement", "hsc", "ssc", "cbse", "icse",
    "maharashtra", "pune", "nagpur", "mumbai", "kolhapur", "education", "science", "arts", "commerce",
)
LEAST_SCORE = 20.0


def _once(x: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def text_lines(text: Column) -> Column:
    """Lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _first(lines: Column, test) -> Column:
    """The place of the first line that passes, from 0; null without one."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i)), lambda i: i.isNotNull()))


def holder_score(line: Column, bonus: Column) -> Column:
    """How much a line is like a holder's name: letters, words, capitals, and how near it stands."""
    words = _words(line)
    n = F.size(words)
    capital = F.forall(words, lambda w: (F.length(w) < 2) | (w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]")))
    title = F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.regexp_count(line, F.lit(r"\p{L}")) / F.greatest(F.length(line), F.lit(1)) * 40 + F.when(n.between(2, 3), 30).when(n == 4, 22).when(n == 5, 10).otherwise(0) + F.when(capital, 20).when(title, 15).otherwise(0) + bonus


def card_holder(text: Column, number: Column) -> Column:
    """A struct of name, line (from 0, blank lines apart), method and score of a tax card's holder; null without one.

    The first of three ways that finds a line like a name decides, by the best score: after the label of names, up to
    the father's label or three lines; below the line with the card's number, up to the father's label or five
    lines; from a fifth to .85 of the lines, not below the father's label. Lines of a label end the first two.
    """

    def found(lines: Column, at: Column, end: Column, stops: Column, method: str, bonus) -> Column:
        stop = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i > at) & (i < end) & F.rlike(x, stops), i)), lambda i: i.isNotNull()))
        ranked = F.transform(lines, lambda x, i: F.when((i > at) & (i < F.least(end, F.coalesce(stop, end))) & ps.name_line(x), F.struct(F.round(holder_score(x, bonus(i - at)), 6).alias("score"), (-i).alias("up"), x.alias("name"), F.lit(method).alias("method"))))
        return F.array_max(F.filter(ranked, lambda c: c.isNotNull()))

    def read(lines: Column) -> Column:
        n = F.size(lines)
        label, father = _first(lines, lambda x: x.rlike(NAME_LABEL)), _first(lines, lambda x: x.rlike(FATHER_LABEL))
        bare = F.replace(F.upper(F.trim(number)), F.lit(" "), F.lit(""))
        numbered = F.when(bare != "", _first(lines, lambda x: F.contains(F.replace(F.upper(x), F.lit(" "), F.lit("")), bare) | F.contains(F.upper(x), F.left(F.upper(F.trim(number)), F.lit(5)))))

        def ways(p: Column) -> Column:
            label_end = F.when(p["father"] > p["label"], p["father"]).otherwise(F.least(p["label"] + 4, n))
            number_end = F.when(p["father"] > p["number"], p["father"]).otherwise(F.least(p["number"] + 6, n))
            first = found(lines, p["label"], label_end, F.lit(f"{FATHER_LABEL}|{BIRTH_LABEL}"), "name_label", lambda far: F.greatest(60 - far * 10, F.lit(0)))
            second = found(lines, p["number"], number_end, F.lit(FATHER_LABEL), "below_number", lambda far: F.greatest(20 - far * 4, F.lit(0)))
            last = F.least(F.floor(n * 0.85).cast("int"), F.coalesce(p["father"] + 1, n))
            third = found(lines, F.floor(n / 5).cast("int") - 1, last, F.lit("(?!)"), "any_line", lambda far: F.lit(0))
            return F.coalesce(F.when(p["label"].isNotNull(), first), F.when(p["number"].isNotNull(), second), third)

        return _once(F.struct(label.alias("label"), father.alias("father"), numbered.alias("number")), ways)

    best = _once(text_lines(text), read)
    return _once(best, lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), (-b["up"]).alias("line"), b["method"].alias("method"), b["score"].alias("score"))))


def _cleaned(x: Column) -> Column:
    return title_case(F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z\s.\-']", " "), r"\s+", " ")))


def identity_name(text: Column) -> Column:
    """A struct of name, line and method of an identity card; null without one.

    The zone is between the card's head and the line of the birth date, else all above that line, else the first .8 of
    the lines. Of the zone's lines that are like a person's name the one nearest to its end is taken; without any, the
    part of a longer line, or of the birth date's, before, between or behind the fields on it.
    """

    def read(lines: Column) -> Column:
        n = F.size(lines)
        head, birth = _first(lines, lambda x: x.rlike(HEAD)), _first(lines, lambda x: x.rlike(BIRTH_LINE) | ps.born(x).isNotNull())

        def zone(p: Column) -> Column:
            between = p["birth"] > F.coalesce(p["head"], F.lit(-1))
            low = F.when(between, F.coalesce(p["head"] + 1, F.lit(0))).otherwise(0)
            high = F.when(p["birth"].isNull(), F.greatest(F.lit(1), F.floor(n * 0.8).cast("int"))).when(p["head"].isNotNull() & between, p["birth"]).otherwise(F.least(p["birth"] + 1, n))
            inside = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text"), ((i >= low) & (i < high)).alias("own"), (i == p["birth"]).alias("dated")))
            whole = F.transform(F.filter(inside, lambda x: x["own"] & ps.human_name(_cleaned(x["text"])) & ~x["text"].rlike(HEAD) & ~x["text"].rlike("[0-9]")), lambda x: F.struct(x["line"].alias("line"), _cleaned(x["text"]).alias("name"), F.lit("zone").alias("method")))
            longer = F.filter(inside, lambda x: (x["own"] & (F.length(x["text"]) > 20)) | (F.coalesce(x["dated"], F.lit(False)) & (F.length(x["text"]) > 10)))
            parts = F.flatten(F.transform(longer, lambda x: F.transform(F.split(x["text"], FIELD_PARTS), lambda part: F.struct(x["line"].alias("line"), _cleaned(part).alias("name"), F.lit("fused_line").alias("method")))))
            fused = F.filter(parts, lambda x: (F.length(x["name"]) >= 4) & ps.human_name(x["name"]))
            return F.coalesce(F.array_max(whole), F.get(fused, F.lit(0)))

        return _once(F.struct(head.alias("head"), birth.alias("birth")), zone)

    return _once(_once(text_lines(text), read), lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), b["line"].alias("line"), b["method"].alias("method"))))


def candidate_score(text: Column) -> Column:
    """How much a run of words is like a candidate's name, by its words, letters, capitals and length."""
    words = _words(text)
    n = F.size(words)
    noise = F.size(F.filter(_words(F.lower(text)), lambda w: w.isin(*ACADEMIC_NOISE)))
    distinct = F.size(F.array_distinct(F.filter(_words(F.lower(text)), lambda w: w.isin(*ACADEMIC_NOISE))))
    score = (
        F.when(n.between(2, 4), 30).when(n == 5, 20).when(n == 1, -20).otherwise(-20 - (n - 5) * 5)
        + F.when(F.forall(words, lambda w: w.rlike(r"^[A-Za-z.\-]+$")), 20).otherwise(-30)
        - F.when(text.rlike("[0-9]"), 30).otherwise(0)
        - F.when(text.rlike(r"[^A-Za-z\s.\-]"), 15).otherwise(0)
        + F.when(text.rlike(r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+)+$"), 15).otherwise(0)
        + F.when(noise == 0, 15).otherwise(distinct * -15)
        + F.when(F.forall(words, lambda w: F.length(w).between(2, 20)), 10).otherwise(0)
        - F.when(text.rlike(r"^[A-Z\s]+$") & (F.length(text) > 20), 10).otherwise(0)
    )
    return F.when(n > 0, score.cast("double")).otherwise(-100.0)


def candidate_name(text: Column) -> Column:
    """A struct of name, method and score of a sheet's text: below the label of a candidate's name, else the best run of words of a line, from 20 points on."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    named = lambda x: F.array_join(F.transform(_words(x), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2), F.lit(1 << 30))))), " ")

    def read(all_: Column) -> Column:
        label = _first(all_, lambda x: F.contains(F.upper(x), F.lit("CANDIDATE")) | F.contains(F.upper(x), F.lit("FULL NAME")))

        def below(at: Column) -> Column:
            fits = lambda x: _once(_words(x), lambda ws: (F.size(ws) >= 2) & (F.size(F.filter(ws, lambda w: w.rlike(r"^[A-Za-z.\-]+$"))) / F.greatest(F.size(ws), F.lit(1)) >= 0.8)) & ~x.rlike("[0-9]")
            return F.get(F.filter(F.transform(all_, lambda x, i: F.when((i > at) & (i < at + 4) & fits(x), x)), lambda x: x.isNotNull()), F.lit(0))

        def runs(x: Column) -> Column:
            words = _words(x)
            some = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda a: F.transform(F.filter(F.sequence(F.lit(2), F.lit(4)), lambda k: a + k - 1 <= F.size(words)), lambda k: F.array_join(F.slice(words, a, k), " "))))
            whole = F.array_join(words, " ")
            return F.when(F.size(words) > 0, F.concat(F.array(whole), F.filter(some, lambda r: r != whole))).otherwise(F.array().cast("array<string>"))

        ranked = F.array_max(F.transform(F.flatten(F.transform(all_, runs)), lambda r, i: F.struct(candidate_score(r).alias("score"), (-i).alias("up"), r.alias("name"))))

        def choose(c: Column) -> Column:
            by_label = F.when(c["below"].isNotNull(), F.struct(named(c["below"]).alias("name"), F.lit("label").alias("method"), F.lit(None).cast("double").alias("score")))
            by_form = F.when(c["best"]["score"] >= LEAST_SCORE, F.struct(named(c["best"]["name"]).alias("name"), F.lit("ranked").alias("method"), c["best"]["score"].alias("score")))
            return F.coalesce(by_label, by_form)

        return _once(F.struct(_once(label, below).alias("below"), ranked.alias("best")), choose)

    return _once(lines, read)
