"""Fields of marksheets from positioned words: candidates of several strategies, ranked page by page.

Words are (doc, page, word_id, text, conf, x1, y1, x2, y2). Lines are gaps and islands of a page's words; a page then
is one row with the array of its lines, and what stands beside, below and around a line is looked up in that array, so
all extractors of a page run in one pass without a join. A page's lines are few, whatever the number of pages.
Digits are those of ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.operators.layout import PAGE

# Labels of percentages and names, words of institutions, and what is no part of a name.
PERCENT_LABELS = ("percentage", "टक्केवारी", "टकेवारी", "percent", "aggregate", "%")
PERCENT_LABEL = r"(?i)percent|टक्केवारी|टकेवारी|%|aggregate"
NAME_LABELS = (
    "candidate's full name", "candidate full name", "candidates full name", "name of the candidate", "name of candidate",
    "candidate name", "student's name", "student name", "full name", "surname first", "beginning with surname",
    "name beginning", "this is to certify that", "certify that", "name",
    "उमेदवाराचे संपूर्ण नाव", "उमेदवाराचे", "संपूर्ण नाव", "आडनाव प्रथम", "नाव",
)
INSTITUTION = (
    r"(?iU)\b(?:board|education|secondary|certificate|statement|school|college|university|division|divisional|state|"
    r"maharashtra|msbshse|pune|mumbai|nashik|kolhapur|nagpur|aurangabad|institute|higher|council|examination|"
    r"marksheet|marks|senior|junior|technical|polytechnic|result|pass|fail|distinction|percentage|grade|subject)\b"
    r"|msbshse|cbse|icse|neet|jee"
)
NO_NAME_SIGN = r"[/\\|@#$%^&*(){}\[\]<>=+~`]"
NO_NAME_WORD = r"(?iU)\b(?:candidate|student|full\s+name|surname|father|mother|आईचे|father.?s)\b"
PARENT, PARENT_FIRST = r"(?iU)\b(?:mother|father|aai|baba|parent)\b", r"(?i)^(?:mother|father|aai|baba|parent)"
NO_PERSON = (
    r"(?iU)\b(?:board|university|exam|marksheet|result|percentage|grade|college|institute|school|statement|certificate|"
    r"marks|pune|kolhapur|mumbai|nashik|nagpur|state|division|divisional|higher|secondary|education|msbshse|science|arts|"
    r"commerce|stream|seat|center|centre|district|region|date|year|march|april|may|june|july|august|september|october|"
    r"november|december|january|february)\b"
)
SERIAL = r"(?i)^[A-Z]{0,3}[0-9]{6,}$|^[A-Z][-][0-9]{5,}$|^[A-Z]{2}[0-9]{9,}$|[0-9]{10,}"
DECIMAL = r"(?U)\b([0-9]{1,3}[.,][0-9]{1,2})\b"
RESULTS = (
    (r"(?U)\bI[-\s]?DIST\b|\bDISTINCTION\b|\bWITH\s+DISTINCTION\b", "DISTINCTION"),
    (r"(?U)\bGRADE\s+I\b|\bFIRST\s+CLASS\b|\bFIRST\s+GRADE\b", "FIRST CLASS"),
    (r"(?U)\bGRADE\s+II\b|\bSECOND\s+CLASS\b|\bSECOND\s+GRADE\b", "SECOND CLASS"),
    (r"(?U)\bPASS\b", "PASS"),
    (r"(?U)\bFAIL\b|\bFAILED\b", "FAIL"),
)
CGPA_LABEL = r"(?i)cgpa|cumulative gpa|cpi|overall gpa|grade point"
SUMMARY_ROW = r"(?U)\b[0-9]{1,2}\s+([0-9]\.[0-9]{2})\s+[0-9]{2,3}\s+([0-9]\.[0-9]{2})\b"
TERM = r"(?iU)\bSPI\s*[:\s]\s*([0-9]\.[0-9]{2,3})\b"
NEW_TOTAL = r"(?i)(?:total\s*marks?|एकूण\s*गुण)[^0-9]{0,50}([0-9]{3,4})[^0-9]{1,20}([0-9]{3,4})"
GRACE_TOTAL = r"(?i)(?:total|एकूण)[^0-9]{0,30}([0-9]{3,4})[^0-9£$]{0,10}[£$]?([0-9]{3,4})(?:\+([0-9]{1,3}))?"
YEARS = r"((?:19|20)[0-9]{2})[-–]([0-9]{2,4})"
LINE_REACH = 0.6


def sheet_lines(words: DataFrame) -> DataFrame:
    """(doc, page, line, text, x, y, w, h, words): words from top to bottom stay in a line while each begins within .6 of the last one's height.

    ``words`` are (word_id, text, right, bottom) of the line. Words without a text are empty ones; a page without
    words has no row; ties go by place from the left and then by number.
    """
    order = Window.partitionBy(*PAGE).orderBy("y1", "x1", "word_id")
    x = words.select(*PAGE, "word_id", F.coalesce("text", F.lit("")).alias("text"), "x1", "y1", "x2", "y2")
    fall = F.abs(F.col("y1") - F.lag("y1").over(order)) >= F.lag(F.col("y2") - F.col("y1")).over(order) * LINE_REACH
    x = x.withColumn("line", F.sum(F.when(fall, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "y1", "word_id", "text"))), lambda w: w["text"]), " ")
    g = x.groupBy(*PAGE, "line").agg(text.alias("text"), F.min("x1").alias("x"), F.min("y1").alias("y"), F.max("x2").alias("right"), F.max("y2").alias("bottom"), F.collect_list(F.struct("word_id", "text")).alias("words"))
    return g.select(*PAGE, "line", "text", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "words")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def percentage_number(text: Column) -> Column:
    """The first number of a text if it is one from 0 to 100 and the text is no serial number."""
    t = F.trim(text)
    x = F.nullif(F.regexp_extract(t, r"(?U)\b([0-9]{1,3}(?:\.[0-9]{1,2})?)\b", 1), F.lit("")).cast("double")
    return F.when(~t.rlike(SERIAL) & (x <= 100), x)


def name_score(text: Column, nearness: Column) -> Column:
    """How much a text is like a person's name beside a label; null if it can't be one."""
    t = F.trim(text)
    words = _words(t)
    n, digits = F.size(words), F.regexp_count(t, F.lit("[0-9]"))
    refused = (t == "") | t.rlike(INSTITUTION) | (digits > 2) | t.rlike(NO_NAME_SIGN) | (n > 6) | (F.length(F.replace(t, F.lit(" "), F.lit(""))) < 3) | t.rlike(NO_NAME_WORD)
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    title = t.rlike(r"[\p{Lu}\p{Lt}]") & ~t.rlike(rf"{cased}[\p{{Lu}}\p{{Lt}}]") & ~t.rlike(r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
    upper = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(t) > 3)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    points = (
        F.when(n.between(2, 4), 5.0).when((n == 1) & (F.length(t) >= 5), 1.5).when(n == 5, 3.0).otherwise(0.0)
        + F.when(title, 4.0).when(upper, 3.5).when(t.rlike(r"^\p{Lu}"), 1.0).otherwise(0.0)
        + F.when(F.replace(t, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$"), 3.0).otherwise(0.0)
        + F.when((n >= 2) & (letters / F.greatest(n, F.lit(1))).between(3, 12), 1.5).otherwise(0.0)
        + nearness * 6.0
        - F.when(digits > 0, 8.0).otherwise(0.0)
        - F.when(n == 5, 1.0).when(n == 6, 2.0).otherwise(0.0)
    )
    return F.when(~refused, points)


def repaired_name(text: Column) -> Column:
    """Misread digits and signs as the letters that they stand for, in a text of letters for the most part."""
    return F.when(F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(F.length(text), F.lit(1)) >= 0.5, F.translate(text, "0158$|@", "OISBSIA")).otherwise(text)


def _letters(text: Column) -> Column:
    """What label scores compare of a text: itself in lower case, its words of letters, and its pairs of letters."""
    t = F.trim(F.lower(text))

    def parts(clean: Column) -> Column:
        pairs = _once(F.replace(clean, F.lit(" "), F.lit("")), lambda s: F.when(F.length(s) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>")))
        return F.struct(t.alias("low"), _words(clean).alias("words"), pairs.alias("pairs"))

    return _once(F.regexp_replace(t, r"[^a-z\x{0900}-\x{097f}\s]", " "), parts)


def _label_scores(said: Column) -> Column:
    """(score, up, label) of each name label, as ``parsers.label_score`` has it, from the letters of a text.

    Labels are constants, so their words and pairs are worked out here, once for all lines.
    """
    has = lambda w: F.when(F.exists(said["words"], lambda x: F.contains(x, F.lit(w))), 1).otherwise(0)
    scored = []
    for i, label in enumerate(NAME_LABELS):
        clean = re.sub(r"[^a-z\u0900-\u097f\s]", " ", label)
        joined = clean.replace(" ", "")
        words, pairs = clean.split(), sorted({joined[j : j + 2] for j in range(len(joined) - 1)})
        hits = sum((has(w) for w in words), F.lit(0))
        shared = F.size(F.array_intersect(said["pairs"], F.array(*[F.lit(x) for x in pairs])))
        partly = hits / len(words) * 0.6 + F.when(F.size(said["pairs"]) > 0, shared / F.greatest(F.size(said["pairs"]) + len(pairs) - shared, F.lit(1))).otherwise(0.0) * 0.4
        whole = F.when(said["low"].rlike(r"\bname\b"), 1.0).otherwise(0.0) if label == "name" else F.lit(1.0)
        score = F.when(said["low"] == "", 0.0).when(F.contains(said["low"], F.lit(label)), whole).otherwise(partly)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("up"), F.lit(label).alias("label")))
    return F.array(*scored)


def _judged_lines(words: DataFrame) -> DataFrame:
    """Lines with what can be said of each by itself."""
    x = sheet_lines(words)
    x = x.withColumn("trimmed", F.trim("text")).withColumn("parent", F.col("text").rlike(PARENT))
    left = F.regexp_extract("text", rf"(?s)^(.*?){PARENT}", 1)
    x = x.withColumn("stop", F.when(F.col("parent"), F.length(left)))
    x = x.withColumn("said", F.when(F.col("parent"), F.trim(left)).otherwise(F.col("text")))
    x = x.withColumn("letters", _letters(F.col("said"))).withColumn("best", F.array_max(_label_scores(F.col("letters"))))
    x = x.withColumn("all_letters", F.when(F.col("parent"), _letters(F.col("text"))))
    spread = F.least(F.size(F.split("best.label", " ")) / 5.0, F.lit(1.0))
    hit = (F.col("best.score") >= 0.68) & (F.trim("said") != "") & ~(F.col("parent") & F.col("said").rlike(PARENT_FIRST))
    x = x.withColumn("label", F.when(hit, F.struct(F.round(spread, 3).alias("breadth"), F.round("best.score", 3).alias("score"), F.col("best.label").alias("text"))))
    whole = F.when(F.col("parent"), F.array_max(_label_scores(F.col("all_letters")))["score"] >= 0.65).otherwise(F.col("best.score") >= 0.65)
    low, up = F.lower("text"), F.upper("text")
    contains = lambda t, *some: F.exists(F.array(*[F.lit(w) for w in some]), lambda w: F.contains(t, w))
    return x.select(
        *PAGE, F.col("line").alias("n"), "text", "trimmed", "x", "y", "w", "h", "words", "stop", "said", "label",
        whole.alias("is_label"),
        F.col("text").rlike(INSTITUTION).alias("institution"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digits"),
        contains(low, *PERCENT_LABELS).alias("percent_label"),
        F.col("text").rlike("(?i)percent|%").alias("percent_sign"),
        F.col("text").rlike(PERCENT_LABEL).alias("percent_line"),
        _found(F.regexp_replace("text", PERCENT_LABEL, ""), DECIMAL).alias("percent_beside"),
        _found(F.col("text"), DECIMAL).alias("decimal"),
        F.when(contains(up, "OBTAINED") & F.contains(up, F.lit("MARKS")), F.try_element_at(F.regexp_extract_all("text", F.lit(r"(?U)\b([0-9]{2,4})\b"), 1), F.lit(-1))).alias("obtained"),
        F.when((contains(up, "MAXIMUM") & contains(up, "MARKS")) | (contains(up, "GRAND") & contains(up, "TOTAL")), F.array_max(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?U)\b([0-9]{3,4})\b"), 1), lambda m: m.cast("int")), lambda m: m >= 100))).alias("total"),
        F.col("text").rlike(CGPA_LABEL).alias("average_line"),
        F.regexp_extract_all(F.regexp_replace("text", CGPA_LABEL, ""), F.lit(r"(?U)\b([0-9]{1,2}[.,][0-9]{1,4})\b"), 1).alias("averages_beside"),
        F.regexp_extract_all("text", F.lit(r"(?U)\b([0-9]{1,2}[.,][0-9]{1,4})\b"), 1).alias("averages"),
    )


def sheet_pages(words: DataFrame) -> DataFrame:
    """(doc, page, lines, text, width, height): a row per page, its lines from top to bottom and its words in their own order."""
    judged = _judged_lines(words)
    kept = [c for c in judged.columns if c not in (*PAGE, "words")]
    told = F.array_sort(F.flatten(F.collect_list("words")))
    return judged.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct(*kept))).alias("lines"),
        F.array_join(F.transform(told, lambda w: w["text"]), " ").alias("text"),
        F.max(F.col("x") + F.col("w")).alias("width"),
        F.max(F.col("y") + F.col("h")).alias("height"),
    )


def _right_gap(a: Column, b: Column) -> Column:
    """How far b begins to the right of a's end in a's row; null where it doesn't stand there."""
    gap = b["x"] - (a["x"] + a["w"])
    return F.when((a["n"] != b["n"]) & (F.abs(a["y"] - b["y"]) < a["h"] * 0.8) & (b["x"] >= a["x"]) & (gap >= 0), gap)


def _below_gap(a: Column, b: Column) -> Column:
    """How far b begins below a's lower edge, where they overlap or nearly do; null elsewhere."""
    gap = b["y"] - (a["y"] + a["h"])
    aside = F.greatest(a["x"], b["x"]) < F.least(a["x"] + a["w"], b["x"] + b["w"]) + 100
    return F.when((a["n"] != b["n"]) & (b["y"] > a["y"]) & aside & (gap >= 0), gap)


def _nearest(lines: Column, a: Column, gap: Callable[[Column, Column], Column]) -> Column:
    """The number of the line at the smallest gap from ``a``, the upper of equals."""
    far = F.filter(F.transform(lines, lambda b: F.struct(gap(a, b).alias("far"), b["n"].alias("n"))), lambda s: s["far"].isNotNull())
    return F.array_min(far)["n"]


def _line(lines: Column, n: Column) -> Column:
    return F.when(n.isNotNull(), F.get(lines, n.cast("int")))


def _left_of(lines: Column, b: Column) -> Column:
    """The last line to which ``b`` was the nearest on the right, as lines are gone through from the top."""
    meets = F.filter(lines, lambda a: F.coalesce(_right_gap(a, b) >= 0, F.lit(False)) & ~F.exists(lines, lambda c: F.coalesce((c["n"] < b["n"]) & (_right_gap(a, c) <= _right_gap(a, b)), F.lit(False))))
    return F.try_element_at(F.transform(meets, lambda a: a["n"]), F.lit(-1))


def _percent_points(text: Column, beside: Column, under: Column) -> Column:
    """How likely a candidate is to be a percentage, by its form and by the label beside or above it."""
    t = F.trim(text)
    words, number = _words(t), percentage_number(text)
    pair = (F.size(words) == 2) & F.forall(words, lambda w: w.rlike("^[0-9]+$"))
    wordy = F.when(F.exists(words, lambda w: w.rlike("^[A-Za-z]{3,}$")), -20.0).otherwise(0.0)
    form = wordy + 5.0 + F.when(t.rlike(r"[0-9]\.[0-9]"), 4.0).otherwise(0.0) + F.when(F.size(words) == 1, 3.0).when(pair, 1.0).otherwise(0.0) + F.when(number >= 30, 1.0).otherwise(0.0) + F.when(F.contains(t, F.lit("%")), 3.0).otherwise(0.0)
    near = F.when(beside, 8.0).otherwise(0.0) + F.when(under, 6.0).otherwise(0.0)
    return F.when(t.rlike("(?i)[A-Z][0-9]{6,}") | t.rlike("[0-9]{8,}"), -100.0).when(number.isNull(), -50.0).otherwise(form + near)


def _linked_percentage(lines: Column) -> Column:
    """The best value that the places around a label give: a struct of value, score and strategy, or null.

    Of each line with a label: the line to the right, the line below, two more to the right, and what its own text
    has besides the label; a value counts where it is first seen.
    """
    inline = r"(?i)" + "|".join(sorted((rf"\Q{w}\E" for w in PERCENT_LABELS), key=len, reverse=True))

    def places(a: Column) -> Column:
        def spread(r1: Column) -> Column:
            def further(r2: Column) -> Column:
                r3 = _nearest(lines, _line(lines, r2), _right_gap)
                rest = F.regexp_replace(F.regexp_replace(a["text"], inline, ""), r"^[ :/\-|]+|[ :/\-|]+$", "")
                own = F.when((rest != "") & (rest != a["trimmed"]), rest)
                at = lambda n, how: F.struct(_line(lines, n)["text"].alias("value"), n.alias("n"), F.lit(how).alias("strategy"))
                return F.array(at(r1, "nearest_right"), at(_nearest(lines, a, _below_gap), "nearest_below"), at(r2, "right_hop"), at(r3, "right_hop"), F.struct(own.alias("value"), a["n"].alias("n"), F.lit("inline").alias("strategy")))

            return _once(_nearest(lines, _line(lines, r1), _right_gap), further)

        return _once(_nearest(lines, a, _right_gap), spread)

    found = F.filter(F.flatten(F.transform(F.filter(lines, lambda a: a["percent_label"]), places)), lambda c: c["value"].isNotNull())
    first = lambda all_: F.filter(F.transform(all_, lambda c, i: F.when(F.array_position(F.transform(all_, lambda d: d["value"]), c["value"]) == i + 1, c)), lambda c: c.isNotNull())
    under = F.transform(F.filter(lines, lambda a: a["percent_sign"]), lambda a: _nearest(lines, a, _below_gap))

    def points(c: Column) -> Column:
        beside = F.coalesce(_line(lines, _left_of(lines, _line(lines, c["n"])))["percent_sign"], F.lit(False))
        return _percent_points(c["value"], beside, F.coalesce(F.array_contains(under, c["n"]), F.lit(False)))

    ranked = F.transform(_once(found, first), lambda c, i: F.struct(points(c).alias("score"), (-i).alias("up"), c["value"].alias("value"), c["strategy"].alias("strategy")))
    return F.array_max(ranked)


def _stated_percentage(lines: Column, text: Column) -> Column:
    """A percentage by its surroundings: on the line of a label, on the next, after a label anywhere, or any likely decimal."""

    def made(raw: Column, score: float, strategy: str) -> Column:
        number = percentage_number(F.replace(raw, F.lit(","), F.lit(".")))
        return F.when(number.isNotNull(), F.struct(F.lit(score).alias("score"), F.lit(0).alias("up"), F.format_string("%.2f", number).alias("value"), F.lit(strategy).alias("strategy")))

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))

    same = F.transform(lines, lambda a: F.when(a["percent_line"], made(a["percent_beside"], 10.0, "regex_same_line")))
    after = F.transform(lines, lambda a, i: F.when(~a["percent_line"] & F.coalesce(F.get(lines, i - 1)["percent_line"], F.lit(False)), made(a["decimal"], 9.0, "regex_next_line")))
    near = _found(text, r"(?i)(?:percent|टकेवारी|%)[^0-9]{0,30}[£$]?\s*([0-9]{1,3}[.,\s][0-9]{1,2})")
    decimals = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\b([0-9]{1,3}\.[0-9]{1,2})\b"), 1), lambda d: percentage_number(d) >= 30)
    return F.coalesce(first(same), first(after), made(F.replace(near, F.lit(" "), F.lit(".")), 8.0, "regex_context"), made(F.get(decimals, F.lit(0)), 5.0, "regex_last_resort"))


def percentage(lines: Column, text: Column) -> Column:
    """A struct of value, confidence and strategy: the linked value, unless it has words and the text states one."""
    linked, stated = _linked_percentage(lines), _stated_percentage(lines, text)
    both = _once(F.struct(linked.alias("linked"), stated.alias("stated")), lambda b: F.when(b["linked"].isNull() | (b["linked"]["value"].rlike("[A-Za-z]{3,}") & b["stated"].isNotNull()), b["stated"]).otherwise(b["linked"]))
    return _once(both, lambda c: F.when(c.isNotNull(), F.struct(c["value"].alias("value"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c["score"] / 15.0)).alias("confidence"), c["strategy"].alias("strategy"))))


def _merged_name(lines: Column, first: Column) -> Column:
    """A name that goes on below: lines down to the next label, institution, number, gap or indent join it, up to five words."""
    later = F.array_sort(F.transform(F.filter(lines, lambda b: (b["n"] != first["n"]) & (b["y"] > first["y"]) & (b["trimmed"] != "")), lambda b: F.struct(b["y"].alias("y"), b["n"].alias("n"), b["x"].alias("x"), b["h"].alias("h"), b["trimmed"].alias("text"), (b["is_label"] | b["institution"] | (b["digits"] > 2)).alias("ends"))))
    start = F.struct(first["trimmed"].alias("text"), (first["y"] + first["h"]).alias("bottom"), F.lit(False).alias("done"))

    def join(s: Column, b: Column) -> Column:
        stops = s["done"] | (b["y"] - s["bottom"] > 70) | b["ends"] | (F.abs(b["x"] - first["x"]) > 200)
        text = F.concat_ws(" ", s["text"], b["text"])
        return F.when(stops, F.struct(s["text"].alias("text"), s["bottom"].alias("bottom"), F.lit(True).alias("done"))).otherwise(F.struct(text.alias("text"), (b["y"] + b["h"]).alias("bottom"), (F.size(_words(text)) >= 5).alias("done")))

    return F.aggregate(later, start, join)["text"]


def _near_label(lines: Column, a: Column) -> Column:
    """Texts around a line with a name's label, structs of way, far, n and text: the rest of its own line, then to the right, then below."""
    right, bottom = a["x"] + a["w"], a["y"] + a["h"]
    limit = a["x"] + F.floor(a["w"] * a["stop"] / F.greatest(F.length(a["text"]), F.lit(1)))
    said = F.when(a["stop"].isNotNull(), F.left(a["text"], a["stop"])).otherwise(a["text"])
    at = F.position(a["label"]["text"], F.lower(said))
    rest = F.trim(F.regexp_replace(F.substr(said, at + F.length(a["label"]["text"]), F.lit(1 << 30)), r"^\s*[:.\-]*\s*", ""))
    own = F.when((at > 0) & (F.length(rest) >= 3), F.array(F.struct(F.lit(0).alias("way"), F.lit(0.0).alias("far"), F.lit(-1).cast("long").alias("n"), rest.alias("text"))))

    def entry(b: Column, way: int, far: Column, fits: Column) -> Column:
        return F.when(fits & (b["n"] != a["n"]) & (b["trimmed"] != ""), F.struct(F.lit(way).alias("way"), far.cast("double").alias("far"), b["n"].cast("long").alias("n"), b["trimmed"].alias("text")))

    beside = F.transform(lines, lambda b: entry(b, 1, b["x"] - right, (F.abs(b["y"] - a["y"]) < a["h"] * 1.3) & (b["x"] - right).between(0, 700) & (a["stop"].isNull() | (b["x"] < limit))))
    under = F.transform(lines, lambda b: entry(b, 2, b["y"] - bottom, (F.abs(b["x"] - a["x"]) < F.greatest(a["w"] + 60, F.lit(120))) & (b["y"] - bottom).between(0, 150)))
    around = F.array_sort(F.filter(F.concat(beside, under), lambda c: c.isNotNull()))
    return F.concat(F.coalesce(own, F.array().cast("array<struct<way:int,far:double,n:bigint,text:string>>")), around)


def _labelled_name(lines: Column) -> Column:
    """The best text near any label of names: a struct of score, up and value, or null."""
    hits = F.reverse(F.array_sort(F.transform(F.filter(lines, lambda a: a["label"].isNotNull()), lambda a: F.struct(a["label"]["breadth"].alias("breadth"), a["label"]["score"].alias("score"), (-a["n"]).alias("up"), a.alias("a")))))
    near = F.flatten(F.transform(hits, lambda h: F.transform(_near_label(lines, h["a"]), lambda c: F.struct(c["text"].alias("text"), (F.when(c["way"] < 2, 1.0).otherwise(0.85) * h["score"]).alias("nearness")))))
    usable = F.filter(near, lambda c: F.coalesce(name_score(c["text"], c["nearness"]) > 0, F.lit(False)))

    def whole(c: Column, i: Column) -> Column:
        start = F.get(F.filter(lines, lambda b: b["trimmed"] == c["text"]), F.lit(0))
        value = repaired_name(_once(start, lambda s: F.when(s.isNotNull(), _merged_name(lines, s)).otherwise(c["text"])))
        return _once(value, lambda v: F.struct(name_score(v, c["nearness"]).alias("score"), (-i).alias("up"), v.alias("value")))

    return F.array_max(F.filter(F.transform(usable, whole), lambda c: F.coalesce(c["score"] > 0, F.lit(False))))


def _central_name(lines: Column, width: Column, height: Column) -> Column:
    """The best text like a name in the middle of the page between a tenth and four tenths of its height."""
    inside = F.filter(lines, lambda b: b["y"].between(height * 0.10, height * 0.40) & (F.abs(b["x"] + b["w"] / 2 - width / 2) <= width * 0.40))
    ranked = F.transform(inside, lambda b: F.struct(name_score(b["trimmed"], F.lit(0.2)).alias("score"), (-b["n"]).alias("up"), b["trimmed"].alias("value")))
    best = F.array_max(F.filter(ranked, lambda c: F.coalesce(c["score"] > 2.0, F.lit(False))))
    return _once(repaired_name(best["value"]), lambda v: _once(name_score(v, F.lit(0.2)), lambda s: F.when(s > 2.5, F.struct(s.alias("score"), F.lit(0).alias("up"), v.alias("value")))))


def name(lines: Column, width: Column, height: Column) -> Column:
    """A struct of value, confidence and strategy: near a label, else in the page's middle, else a line that has the form of a name."""
    best = F.coalesce(_labelled_name(lines), _central_name(lines, width, height))
    formed = F.filter(F.slice(lines, 1, 20), lambda b: ~b["trimmed"].rlike(NO_PERSON) & b["trimmed"].rlike(r"^(?:[A-Z]{3,}(?:\s+[A-Z]{3,}){2,3}|[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){2,3})$"))
    last = F.get(formed, F.lit(0))["trimmed"]
    sure = lambda c: F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.30), c["score"] / 14.0)), 3)
    field = lambda value, confidence, strategy: F.struct(value.alias("value"), confidence.alias("confidence"), F.lit(strategy).alias("strategy"))
    return _once(best, lambda c: F.when(c.isNotNull(), field(c["value"], sure(c), "name_extractor_v2")).when(last.isNotNull(), field(last, F.lit(0.50), "universal_catchall")))


def marks(lines: Column, text: Column) -> Column:
    """A struct of obtained and total: two numbers after a total's label, rows of marks, and a total with grace marks."""
    last = lambda c: F.try_element_at(F.filter(F.transform(lines, lambda a: a[c].cast("double")), lambda x: x.isNotNull()), F.lit(-1))
    new = [_found(text, NEW_TOTAL, i).cast("double") for i in (1, 2)]
    old = [_found(text, GRACE_TOTAL, 1).cast("double"), _found(text, GRACE_TOTAL, 2).cast("double") + F.coalesce(F.nullif(_found(text, GRACE_TOTAL, 3), F.lit("")).cast("double"), F.lit(0.0))]
    low, high = (lambda p: F.when(p[0].isNotNull(), F.least(*p))), (lambda p: F.when(p[0].isNotNull(), F.greatest(*p)))
    return F.struct(F.coalesce(low(new), last("obtained"), low(old)).alias("obtained"), F.coalesce(high(new), last("total"), high(old)).alias("total"))


def result(text: Column) -> Column:
    up = F.upper(text)
    return F.coalesce(*[F.when(up.rlike(p), label) for p, label in RESULTS])


def passing_year(text: Column) -> Column:
    """Years of a session as YYYY-YYYY, near a word for it or anywhere, else a year near such a word, else the latest likely one."""

    def session(pattern: str) -> Column:
        first, second = _found(text, pattern, 1), _found(text, pattern, 2)
        return F.concat(first, F.lit("-"), F.when(F.length(second) == 2, F.concat(F.left(first, F.lit(2)), second)).otherwise(second))

    near = r"(?i)(?:year|batch|session|passing|exam|examination|academic)[^0-9]{0,30}"
    alone = F.array_max(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int").between(1990, 2030)))
    return F.coalesce(session(near + YEARS), session(r"(?U)\b" + YEARS + r"\b"), _found(text, r"(?i)(?:year|batch|session|passing|exam)[^0-9]{0,30}((?:19|20)[0-9]{2})"), alone)


def averages(lines: Column, text: Column) -> Column:
    """A struct of cpi, cgpa (as stated), other (near a label of averages) and terms, an array of semester and spi by semester.

    The summary row of a term gives a term 99. A term's value counts once; one said to be cumulative is the CPI.
    """
    graded = lambda x: F.when((x > 0) & (x <= 10), x)

    def stated(word: str) -> Column:
        every = F.regexp_extract_all(text, F.lit(rf"(?iU)\b{word}\s*[:\s]\s*([0-9]\.[0-9]{{2,3}})\b"), 1)
        return F.round(F.get(F.filter(F.transform(every, lambda m: graded(m.cast("double"))), lambda x: x.isNotNull()), F.lit(0)), 2)

    at = F.locate("performance", F.lower(text))
    zone = F.when(at > 0, F.substr(text, at, F.lit(1 << 30))).otherwise(F.right(text, F.lit(600)))
    row_term, row_all = graded(_found(zone, SUMMARY_ROW, 1).cast("double")), graded(_found(zone, SUMMARY_ROW, 2).cast("double"))
    term = lambda n, x: F.struct(n.cast("int").alias("semester"), F.round(x, 2).alias("spi"))
    none = F.array().cast("array<struct<semester:int,spi:double>>")
    start = F.struct(F.coalesce(stated("CPI"), F.round(row_all, 2)).alias("cpi"), F.coalesce(F.when(row_term.isNotNull(), F.array(term(F.lit(99), row_term))), none).alias("terms"), F.lit("").alias("before"))
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit(" ")), TERM, "\u0001$0"), "\u0001")

    def read(s: Column, piece: Column) -> Column:
        value = graded(F.nullif(F.regexp_extract(piece, "^" + TERM.replace(r"\b", "", 1), 1), F.lit("")).cast("double"))
        before = s["before"]
        overall = before.rlike(r"(?iU)\b(?:cumulative|CPI|aggregate|overall)\b")
        raw = F.upper(F.regexp_extract(before, r"(?iU)\bsem(?:ester)?\s+([IVX]{1,4}|[0-9]+)\b", 1))
        roman = F.array_position(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")]), raw)
        number = F.coalesce(raw.try_cast("int"), roman, F.lit(0))
        new = value.isNotNull() & ~overall & ~F.exists(s["terms"], lambda t: t["spi"] == value)
        return F.struct(
            F.coalesce(s["cpi"], F.when(overall, F.round(value, 2))).alias("cpi"),
            F.when(new, F.concat(s["terms"], F.array(term(number, value)))).otherwise(s["terms"]).alias("terms"),
            F.right(F.concat(before, piece), F.lit(120)).alias("before"),
        )

    told = F.aggregate(pieces, start, read)
    near = lambda some: F.filter(F.transform(some, lambda m: F.replace(m, F.lit(","), F.lit(".")).cast("double")), lambda x: x <= 10)
    same = F.flatten(F.transform(F.filter(lines, lambda a: a["average_line"]), lambda a: near(a["averages_beside"])))
    after = F.flatten(F.transform(F.filter(F.transform(lines, lambda a, i: F.when(~a["average_line"] & F.coalesce(F.get(lines, i - 1)["average_line"], F.lit(False)), a)), lambda a: a.isNotNull()), lambda a: near(a["averages"])))
    anywhere = near(F.regexp_extract_all(text, F.lit(rf"(?i)(?:{CGPA_LABEL[4:]})[^0-9]{{0,40}}([0-9]{{1,2}}[.,][0-9]{{1,4}})"), 1))
    other = F.round(F.get(F.concat(same, after, anywhere), F.lit(0)), 4)
    in_order = lambda t: F.transform(F.array_sort(F.transform(t, lambda x, i: F.struct(x["semester"].alias("semester"), i.alias("i"), x["spi"].alias("spi")))), lambda x: F.struct(x["semester"].alias("semester"), x["spi"].alias("spi")))
    return _once(told, lambda s: F.struct(s["cpi"].alias("cpi"), stated("CGPA").alias("cgpa"), other.alias("other"), in_order(s["terms"]).alias("terms")))


def sheet_fields(words: DataFrame) -> DataFrame:
    """(doc, page, field, value, confidence, strategy): a row per page and field that some strategy finds.

    A later strategy takes the place of an earlier one that found nothing, or, for percentages, words. Terms and the
    score to be shown are JSON. Words without a text, repeated words and pages without any of the fields are fine; an
    empty table gives none. Other columns aren't read.
    """
    pages = sheet_pages(words)
    x = pages.select(
        *PAGE, "text",
        name(F.col("lines"), F.col("width"), F.col("height")).alias("name"),
        percentage(F.col("lines"), F.col("text")).alias("percentage"),
        marks(F.col("lines"), F.col("text")).alias("marks"),
        averages(F.col("lines"), F.col("text")).alias("a"),
    )
    latest = F.array_max(F.transform("a.terms", lambda t, i: F.struct(t["semester"].alias("semester"), (-i).alias("up"), t["spi"].alias("spi"))))["spi"]
    shown = F.when(F.col("a.cpi").isNotNull(), F.struct(F.lit("CPI").alias("type"), F.col("a.cpi").alias("value"))).when(F.col("a.cgpa").isNotNull(), F.struct(F.lit("CGPA").alias("type"), F.col("a.cgpa").alias("value"))).when(latest.isNotNull(), F.struct(F.lit("SPI").alias("type"), latest.alias("value")))
    field = lambda n, value, confidence, strategy: F.struct(F.lit(n).alias("field"), value.cast("string").alias("value"), F.lit(confidence).alias("confidence"), F.lit(strategy).alias("strategy"))
    taken = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"{n}.value").alias("value"), F.col(f"{n}.confidence").alias("confidence"), F.col(f"{n}.strategy").alias("strategy"))
    fields = F.array(
        taken("name"),
        taken("percentage"),
        field("obtained_marks", F.col("marks.obtained"), 0.85, "regex_marks"),
        field("total_marks", F.col("marks.total"), 0.85, "regex_marks"),
        field("result", result(F.col("text")), 0.90, "regex_result"),
        field("cgpa", F.coalesce("a.cgpa", "a.other"), 0.88, "regex_cgpa"),
        field("cpi", F.col("a.cpi"), 0.92, "academic_resolver"),
        field("spi", latest, 0.90, "academic_resolver_latest_sem"),
        field("semester_scores", F.when(F.size("a.terms") > 0, F.to_json(F.filter("a.terms", lambda t: t["semester"] != 99))), 0.90, "academic_resolver"),
        field("display_score", F.to_json(shown), 0.95, "academic_priority_resolver"),
        field("passing_year", passing_year(F.col("text")), 0.88, "regex_year"),
    )
    return x.select(*PAGE, F.inline(fields)).where(F.col("value").isNotNull())
