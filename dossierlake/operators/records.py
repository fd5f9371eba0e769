"""Latest records, joins of users with their records, identity collisions and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def latest_extractions(extracted: DataFrame) -> DataFrame:
    """Per user and type the last processed row, the larger id of equals."""
    return latest(extracted, ["user_id", "doc_type"], F.desc("processed_at"), F.desc("id"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return latest(reviews, ["user_id"], F.desc("created_at"), F.desc("id"))


def user_overview(users: DataFrame, extracted: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every user with the types that have an extraction, the newest confidence, the state of the latest review and the status that is shown."""
    last = latest_extractions(extracted)
    types = last.groupBy("user_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("doc_type"))).alias("doc_types"), F.max_by("confidence_score", F.struct("processed_at", "id")).alias("confidence"))
    review = latest_reviews(reviews).select("user_id", F.col("status").alias("review_status"), F.col("decision").alias("review_decision"))
    u = users.withColumnRenamed("id", "user_id")
    joined = u.join(types, "user_id", "left").join(review, "user_id", "left")
    shown = display_status(F.col("status"), F.col("workflow_state"), F.col("review_status"), F.col("review_decision"))
    return joined.select("user_id", "full_name", "doc_types", "confidence", "review_status", "review_decision", shown.alias("display_status"))


#: States of a user that stand as they are set.
SET_STATES = ("REJECTED", "APPROVED", "REVIEW_REQUIRED", "UPLOADED", "PROCESSING")


def display_status(status: Column, workflow: Column, review_status: Column, review_decision: Column) -> Column:
    """What is shown of a user: verified, then a state that was set, then what the latest review says, then pending."""
    own, flow = F.upper(F.coalesce(status, F.lit(""))), F.upper(F.coalesce(workflow, F.lit("")))
    return (
        F.when((own == "VERIFIED") | (flow == "VERIFIED"), "VERIFIED")
        .when(own.isin(*SET_STATES), own)
        .when((review_status == "completed") & (review_decision == "approved"), "VERIFIED")
        .when(review_decision == "rejected", "REJECTED")
        .when(review_status == "pending", "REVIEW_REQUIRED")
        .when(review_status.isNotNull(), own)
        .otherwise("PENDING")
    )


def id_collisions(rows: DataFrame, normalise: Column, kind: str) -> DataFrame:
    """Users that share a non-empty number with others: the number, the user, the first of its users, the rows of this one and the number of others.

    A number is a class and its users the members, so a placeholder that many share gives a row a user, never a row a
    pair. Users of one number are those whose rows name it.
    """
    folded = rows.select("user_id", normalise.alias("number")).where(F.length("number") > 0).groupBy("number", "user_id").agg(F.count(F.lit(1)).alias("n"))
    shared = folded.groupBy("number").agg(F.count(F.lit(1)).alias("users"), F.min("user_id").alias("first_user")).where("users > 1")
    return folded.join(shared, "number").select(F.lit(kind).alias("match_type"), "number", "user_id", "first_user", "n", (F.col("users") - 1).alias("others"))


def aadhaar_number(column: str = "aadhaar_number") -> Column:
    """White space goes, hyphens stay."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"\s", "")


def pan_number(column: str = "pan_number") -> Column:
    return F.upper(F.coalesce(column, F.lit("")))


def same_names(users: DataFrame, least_others: int = 3) -> DataFrame:
    """Users whose name of two words or more at least ``least_others`` others share, letter case apart."""
    named = users.where(F.size(F.split(F.trim("full_name"), r"\s+")) >= 2)
    key = F.lower(F.trim("full_name"))
    counted = named.groupBy(key.alias("name_key")).agg(F.count(F.lit(1)).alias("holders"))
    return named.withColumn("name_key", key).join(counted.where(F.col("holders") > least_others), "name_key").select("id", "full_name", (F.col("holders") - 1).alias("others"))


def missing_type(users: DataFrame, extracted: DataFrame, doc_type: str) -> DataFrame:
    """Users without an extraction of the type."""
    return users.join(extracted.where(F.col("doc_type") == doc_type), users["id"] == extracted["user_id"], "left_anti").select("id", "full_name")


def top_risky(rows: DataFrame, top: int = 10, corrected: bool = False) -> DataFrame:
    """Users of the highest risks from 50 on. The limit comes before repeated users are dropped; ``corrected`` drops them first."""
    risky = rows.where("risk_score >= 50").select("user_id", "risk_score", "risk_level", "id")
    if corrected:
        return latest(risky, ["user_id"], F.desc("risk_score"), F.asc("id")).orderBy(F.desc("risk_score"), "id").limit(top).drop("id")
    cut = risky.orderBy(F.desc("risk_score"), "id").limit(top)
    return latest(cut, ["user_id"], F.desc("risk_score"), F.asc("id")).drop("id")


def audit_events(reviews: DataFrame, corrections: DataFrame, uploads: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews, corrections and uploads in one schema; with ``limit`` the newest so many of each source."""
    parts = [
        reviews.select(F.lit("review").alias("source"), F.col("status").alias("action"), F.col("id").alias("ref"), F.col("created_at").cast("timestamp_ntz").alias("happened_at")),
        corrections.select(F.lit("correction").alias("source"), F.col("correction_type").alias("action"), F.col("review_id").alias("ref"), F.col("created_at").cast("timestamp_ntz").alias("happened_at")),
        uploads.select(F.lit("upload").alias("source"), F.col("doc_type").alias("action"), F.col("id").alias("ref"), F.col("uploaded_at").cast("timestamp_ntz").alias("happened_at")),
    ]
    if limit:
        parts = [p.orderBy(F.desc("happened_at"), "ref", "action").limit(limit) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filtered(reviews: DataFrame, status: str | None = None, **equal: object) -> DataFrame:
    """Reviews of a status, the waiting ones without one, and of the given values of other columns; None asks for nothing."""
    out = reviews.where(F.col("status") == status) if status else reviews.where(F.col("status").isin("pending", "in_review"))
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in values])


def audit_filter(events: DataFrame, action: str | None = None, text: str | None = None) -> DataFrame:
    """Events of an action and with a text in any of their words."""
    out = events if action is None else events.where(F.col("action") == action)
    return out if text is None else out.where(F.contains(F.lower(F.concat_ws(" ", "source", "action", F.col("ref").cast("string"))), F.lit(text.lower())))


def user_documents(users: DataFrame, documents: DataFrame) -> DataFrame:
    """Users with their last Aadhaar and PAN document and all academic ones."""
    last = lambda kind: F.max_by(F.when(F.col("doc_type") == kind, F.col("id")), F.when(F.col("doc_type") == kind, F.struct("created_at", "id")))
    ids = F.array_sort(F.collect_list(F.when(F.col("doc_type") == "academic", F.col("id"))))
    some = documents.groupBy("user_id").agg(last("aadhaar").alias("aadhaar"), last("pan").alias("pan"), F.nullif(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("")).alias("academic"))
    return users.select("id").join(some, F.col("id") == F.col("user_id"), "left").drop("user_id")


def top_of_each(rows: DataFrame, key: str, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each key; ranks are cut in each task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= top).drop("_n")


def ranked(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` largest counts with their place; ties go by the key, the first column."""
    key = counts.columns[0]
    best = counts.orderBy(F.desc("n"), key).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))
