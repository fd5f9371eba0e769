"""Risk, duplicate, pattern, confidence and marks arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The share of each component in the risk score.
WEIGHTS = {"tamper": 0.30, "duplicate": 0.25, "quality": 0.20, "metadata": 0.15, "pattern": 0.10}
#: Points of each behaviour flag.
PATTERN_POINTS = {"high_upload_frequency": 25, "repeated_ocr_failures": 20, "repeated_document_rejections": 30, "multiple_users_same_name": 20, "prior_duplicate_match_history": 40}


def clip(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# The penalties of unreadable text, and the upper ends of the risk levels.
def ocr_penalty(confidence: Column) -> Column:
    return F.when(confidence < 0.40, (0.40 - confidence) * 30).when(confidence < 0.70, (0.70 - confidence) * 10).otherwise(0.0)


def risk_score(tamper: Column, duplicate: Column, quality: Column, metadata: Column, pattern: Column, confidence: Column) -> Column:
    """Weighted sum, quality turned round, plus the penalty for unreadable text, cut to a whole number of 100 at most."""
    parts = {"tamper": clip(tamper), "duplicate": clip(duplicate), "quality": 100 - clip(quality), "metadata": clip(metadata), "pattern": clip(pattern)}
    raw = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.least(F.lit(100), (raw + ocr_penalty(confidence)).cast("int"))


def risk_level(score: Column) -> Column:
    return F.when(score <= 24, "LOW_RISK").when(score <= 49, "MEDIUM_RISK").when(score <= 74, "HIGH_RISK").otherwise("CRITICAL_RISK")


def recommendation(level: Column, tamper: Column, duplicate: Column) -> Column:
    critical = F.when(duplicate >= 70, "block_and_investigate_identity_collision").when(tamper >= 70, "block_and_flag_for_fraud_review").otherwise("escalate_to_fraud_team")
    return F.when(level == "CRITICAL_RISK", critical).when(level == "HIGH_RISK", "manual_review_required").when(level == "MEDIUM_RISK", "enhanced_verification_recommended").otherwise("proceed_with_standard_review")


def review_priority(level: Column) -> Column:
    return F.when(level.isin("CRITICAL_RISK", "HIGH_RISK"), 1).when(level == "LOW_RISK", 3).otherwise(2)


def pattern_flags(uploads: Column, failures: Column, rejections: Column, namesakes: Column, duplicates: Column) -> Column:
    """Flags raised by a user's counts."""
    rules = ((uploads > 5, "high_upload_frequency"), (failures >= 3, "repeated_ocr_failures"), (rejections >= 2, "repeated_document_rejections"), (namesakes >= 3, "multiple_users_same_name"), (duplicates > 0, "prior_duplicate_match_history"))
    return F.array_compact(F.array(*[F.when(c, f) for c, f in rules]))


def pattern_score(flags: Column) -> Column:
    points = sum((F.when(F.array_contains(flags, f), p).otherwise(0) for f, p in PATTERN_POINTS.items()), F.lit(0))
    return F.least(F.lit(100), points)


#: How texts state a percentage, and averages of a course or a term, in the order in which they are tried.
PERCENTAGES = (
    r"(?i)percentage[:\s]+([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*%?",
    r"(?i)([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*%",
    r"(?i)percent(?:age)?\s*[:\-]\s*([0-9]{1,3}(?:\.[0-9]{1,2})?)",
    r"(?i)aggregate\s*(?:percentage|%)?\s*[:\-]?\s*([0-9]{1,3}(?:\.[0-9]{1,2})?)",
    r"(?i)([0-9]{2,3}\.[0-9]{2})\s*(?:percent|%|pct)",
)
CGPA = r"(?i)(?:cgpa|cumulative\s+gpa)[:\s\-]*([0-9]+(?:\.[0-9]{1,2})?)"
SGPA = r"(?i)(?:sgpa|semester\s+gpa|sem\s+gpa)[:\s\-]*([0-9]+(?:\.[0-9]{1,2})?)"


def percentage(obtained: Column, total: Column) -> Column:
    """Two digits; null without a positive total that holds the marks."""
    return F.when((total > 0) & (obtained <= total), F.round(obtained / total * 100, 2))


def stated_percentage(text: Column) -> Column:
    """The first percentage up to 100 that a text states, by the first pattern whose first match is one."""
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 1).cast("double")) for p in PERCENTAGES]
    return F.coalesce(*[F.when(x <= 100, F.round(x, 2)) for x in found])


def resolved_percentage(given: Column, obtained: Column, total: Column, text: Column) -> Column:
    """The given percentage if it can be one, else what the marks make, else what the text states."""
    return F.coalesce(F.when((given > 0) & (given <= 100), given), percentage(obtained, total), stated_percentage(text))


def stated_average(text: Column) -> Column:
    x = F.when(text.rlike(CGPA), F.regexp_extract(text, CGPA, 1).cast("double"))
    return F.when(x <= 10, F.round(x, 2))


def stated_terms(text: Column) -> Column:
    """All averages of terms that a text states, up to 10."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SGPA), 1), lambda x: F.round(x.cast("double"), 2)), lambda x: x <= 10)


def course_average(terms: Column) -> Column:
    """The average of terms (structs of sgpa and credits), by credits where all have them; terms of average 0 don't count."""
    some = F.filter(terms, lambda t: F.coalesce(t["sgpa"], F.lit(0.0)) != 0)
    add = lambda of: F.aggregate(some, F.lit(0.0), lambda a, t: a + of(t))
    credits = add(lambda t: t["credits"])
    weighted = F.when(F.forall(some, lambda t: t["credits"].isNotNull()) & (credits > 0), add(lambda t: t["sgpa"] * t["credits"]) / F.nullif(credits, F.lit(0.0)))
    return F.when(F.size(some) > 0, F.round(F.coalesce(weighted, add(lambda t: t["sgpa"]) / F.size(some)), 2))


def cgpa_percentage(cgpa: Column, scale: float = 10.0) -> Column:
    return F.round(cgpa / scale * 100, 2)


def recalibrated(confidence: Column, valid: Column, repaired: Column, retries: Column) -> Column:
    """A repaired value moves half way to .9; validity adds .1 or takes .3; each retry takes .05; within 0 and 1."""
    start = F.when(repaired, (confidence + 0.9) / 2).otherwise(confidence)
    return clip(start + F.when(valid, 0.1).otherwise(-0.3) - retries * 0.05, 0.0, 1.0)


def field_confidence(present: Column, valid: Column, repeated: Column) -> Column:
    """30, and 60 where the pattern holds, and 20 where several readings agree, 100 at most; 0 without a value."""
    return F.when(present, F.least(F.lit(100), F.lit(30) + F.when(valid, 60).otherwise(0) + F.when(repeated, 20).otherwise(0))).otherwise(0)


def box_overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns end in x1, y1, x2, y2 after the given prefixes."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1"))
    area = [(F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1")) for p in (a, b)]
    return F.coalesce(F.try_divide(w * h, area[0] + area[1] - w * h), F.lit(0.0))
