"""Subject rows of marksheets, review events, evaluation against truth, summaries and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions import parsers as ps

#: What a reviewer's action makes of a review and how it is logged.
ACTIONS = {"approve": ("approved", "APPROVED"), "reject": ("rejected", "REJECTED"), "correct": ("corrected", "CORRECTED"), "reprocess": ("reprocess_requested", "REPROCESS_REQUESTED")}
#: The first state of a review by its decision, and how that is logged.
DECISIONS = {"AUTO_APPROVED": ("approved", "AUTO_APPROVED"), "AUTO_REJECTED": ("rejected", "AUTO_REJECTED"), "REVIEW_REQUIRED": ("pending", "SUBMITTED_FOR_REVIEW")}
#: The zone of a document in which a field stands.
ZONES = {"candidate_name": "candidate_zone", "percentage": "summary_zone", "cgpa": "summary_zone", "result": "summary_zone", "grade_class": "summary_zone", "board_university": "header_zone", "passing_year": "header_zone"}


def _chosen(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def subjects(docs: DataFrame, key: str) -> DataFrame:
    """(key, subject, marks_obtained, marks_total, grade): a row per subject of each text.

    Lines of cells are read first; a text with fewer than two such rows also has its lines read as sentences. Of
    rows of one subject, blanks and case apart, the first counts. Lines without a subject's word belong to the
    subject above, which is there already.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col("text"), r"\r\n|\n|\r")).alias("position", "line"))
    rows = lines.select(key, "position", ps.table_row(F.col("line")).alias("table"), ps.text_row(F.col("line")).alias("text"))
    tables = F.count("table.subject").over(Window.partitionBy(key))
    rows = rows.withColumn("tables", tables)
    both = rows.select(key, F.lit(0).alias("way"), "position", F.col("table").alias("row")).where("row.subject IS NOT NULL")
    both = both.unionByName(rows.where("tables < 2").select(key, F.lit(1).alias("way"), "position", F.col("text").alias("row")).where("row.subject IS NOT NULL"))
    name = F.lower(F.replace("row.subject", F.lit(" "), F.lit("")))
    first = Window.partitionBy(key, name).orderBy("way", "position")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "row.*")


def submitted(evaluated: DataFrame) -> DataFrame:
    """Reviews as they enter the queue: evaluated rows with their first status."""
    return evaluated.withColumn("status", F.coalesce(_chosen(F.col("decision"), {d: s for d, (s, _) in DECISIONS.items()}), F.lit("pending")))


def audit_rows(evaluated: DataFrame) -> DataFrame:
    """(id, action, reason, step): that a review was made, and what was decided at once."""
    reason = F.when(F.col("decision") == "AUTO_APPROVED", "all_rules_passed").when(F.col("decision") == "AUTO_REJECTED", F.array_join(F.slice("reasons", 1, 3), "; ")).otherwise("queued_for_reviewer")
    made = F.struct(F.lit("CREATED").alias("action"), F.col("decision").alias("reason"), F.lit(0).alias("step"))
    decided = F.struct(F.coalesce(_chosen(F.col("decision"), {d: a for d, (_, a) in DECISIONS.items()}), F.lit("SUBMITTED_FOR_REVIEW")).alias("action"), reason.alias("reason"), F.lit(1).alias("step"))
    return evaluated.select("id", F.inline(F.array(made, decided)))


def _events(actions: DataFrame) -> DataFrame:
    return actions.withColumn("after", _chosen(F.col("action"), {a: s for a, (s, _) in ACTIONS.items()})).where(F.col("after").isNotNull())


def reviewed(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Each review after its last action, by time and position, then by action and reviewer: status, reviewer and number of actions."""
    last = F.struct("acted_at", "position", "action", "reviewer_id")
    folded = _events(actions).groupBy("id").agg(F.max_by("after", last).alias("after"), F.max_by("reviewer_id", last).alias("by"), F.count(F.lit(1)).alias("n"))
    joined = reviews.select("id", "status", "reviewer_id").join(folded, "id", "left")
    return joined.select("id", F.coalesce("after", "status").alias("status"), F.coalesce("by", "reviewer_id").alias("reviewer_id"), F.coalesce("n", F.lit(0)).alias("actions"))


def action_log(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, action, reviewer_id, acted_at, before, after) of every action that changes a review; before the first stands the review's own state."""
    order = Window.partitionBy("id").orderBy("acted_at", "position", "action", "reviewer_id")
    own = reviews.select("id", F.col("status").alias("first"))
    changed = _events(actions).withColumn("last", F.lag("after").over(order)).join(own, "id", "left")
    return changed.select("id", _chosen(F.col("action"), {a: n for a, (_, n) in ACTIONS.items()}).alias("action"), "reviewer_id", "acted_at", F.coalesce("last", "first").alias("before"), "after")


def against_truth(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(file, field, expected, predicted, match) of every expected value: names by all their words, percentages within 2, marks within 1, results but for case."""
    x = truth.where(F.col("expected").isNotNull()).join(predicted, ["file", "field"], "left")
    apart = F.abs(F.col("predicted").try_cast("double") - F.col("expected").try_cast("double"))
    low = F.lower(F.trim("predicted"))
    rules = (
        F.when(F.col("field") == "name", F.forall(F.split(F.lower(F.trim("expected")), r"\s+"), lambda w: F.contains(low, w)))
        .when(F.col("field") == "percentage", apart <= 2)
        .when(F.col("field") == "result", F.upper(F.trim("predicted")) == F.upper(F.trim("expected")))
        .otherwise(apart <= 1)
    )
    return x.select("file", "field", "expected", "predicted", F.coalesce(rules, F.lit(False)).alias("match"))


def accuracy(compared: DataFrame) -> DataFrame:
    """Hits, trials and accuracy in percent of each field and over all."""
    hits = F.count_if("match")
    sets = compared.groupingSets([["field"], []], "field").agg(hits.alias("hits"), F.count(F.lit(1)).alias("trials"), F.round(hits / F.count(F.lit(1)) * 100, 1).alias("accuracy"), F.grouping("field").alias("_all"))
    return sets.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("field")).alias("field"), "hits", "trials", "accuracy")


def shared_words(a: Column, b: Column) -> Column:
    """Distinct words that both texts have, case apart."""
    words = lambda x: F.filter(F.split(F.upper(x), r"\s+"), lambda w: w != "")
    return F.array_intersect(words(a), words(b))


def failure_mode(field: Column, extracted: Column, expected: Column) -> Column:
    """empty, unknown, near_miss, invalid, correct or wrong."""
    apart = F.abs(extracted.try_cast("double") - expected.try_cast("double"))
    number = F.when(apart <= 3, "near_miss").when(extracted.rlike("[0-9]"), "invalid").otherwise("wrong")
    text = F.when(F.upper(F.trim(extracted)) == F.upper(F.trim(expected)), "correct").when(F.size(shared_words(expected, extracted)) > 0, "near_miss").otherwise("wrong")
    return F.when(F.coalesce(F.trim(extracted), F.lit("")) == "", "empty").when(expected.isNull(), "unknown").when(field.isin("percentage", "cgpa"), number).otherwise(text)


def region_heatmap(failures: DataFrame) -> DataFrame:
    """Failures by the zone of their field."""
    return failures.groupBy(F.coalesce(_chosen(F.col("field"), ZONES), F.lit("unknown_zone")).alias("region")).agg(F.count(F.lit(1)).alias("failures"))


def recommendations(trials: DataFrame) -> DataFrame:
    """(source, subject, advice, measure): for the five largest failure clusters, the two worst zones and the three weakest transforms."""
    failed = trials.where("NOT correct")
    advice = _chosen(F.col("mode"), {"empty": "widen_fallback_crop", "near_miss": "expand_character_table", "invalid": "prefer_adaptive_threshold"})
    clusters = failed.groupBy("transform", "field", "mode").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "transform", "field", "mode").limit(5)
    zones = region_heatmap(failed).orderBy(F.desc("failures"), "region").limit(2).where("failures > 5")
    weak = trials.groupBy("transform").agg(F.round(F.avg(F.col("correct").cast("int")) * 100, 2).alias("score")).orderBy("score", "transform").limit(3).where("score < 60")
    parts = [
        clusters.select(F.lit("cluster").alias("source"), F.concat_ws(":", "field", "transform").alias("subject"), F.coalesce(advice, F.lit("review_spatial_anchors")).alias("advice"), F.col("n").cast("double").alias("measure")),
        zones.select(F.lit("region").alias("source"), F.col("region").alias("subject"), F.lit("preprocess_zone").alias("advice"), F.col("failures").cast("double").alias("measure")),
        weak.select(F.lit("transform").alias("source"), F.col("transform").alias("subject"), F.lit("restore_scan").alias("advice"), F.col("score").alias("measure")),
    ]
    return reduce(DataFrame.unionByName, parts)


def client_summary(profiles: DataFrame) -> DataFrame:
    """Counters and averages of a list of profiles; marks of zero count as none."""
    types = F.coalesce("doc_types", F.array().cast("array<string>"))
    a, p = F.array_contains(types, "aadhaar"), F.array_contains(types, "pan")
    academic = F.size(F.array_except(types, F.array(F.lit("aadhaar"), F.lit("pan")))) > 0
    pct, cgpa = F.nullif("best_pct", F.lit(0.0)), F.nullif("best_cgpa", F.lit(0.0))
    return profiles.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a & p).alias("clean"),
        F.count_if(~a).alias("missing_aadhaar"),
        F.count_if(~p).alias("missing_pan"),
        F.count_if(academic).alias("with_academic"),
        F.round(F.avg(pct) + 1e-9, 1).alias("average_percentage"),
        F.round(F.avg(cgpa) + 1e-9, 2).alias("average_cgpa"),
        F.count_if(pct >= 75).alias("above_75"),
        F.count_if(pct < 60).alias("below_60"),
    )


def known(users: DataFrame, rows: DataFrame) -> DataFrame:
    """Users with whether any of ``rows`` is theirs."""
    some = rows.select(F.col("user_id").alias("id")).distinct().withColumn("known", F.lit(True))
    return users.select("id", "full_name").join(some, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def melted(rows: DataFrame, series: str, key: str, measures: tuple[str, ...]) -> DataFrame:
    """(series, key, measure, value): a row for each measure of each row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in measures])
    return rows.select(F.lit(series).alias("series"), F.col(key).cast("string").alias("key"), F.inline(pairs))
