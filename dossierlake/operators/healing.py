"""Extracted fields of documents, checked, repaired and completed from each other.

Rows are (id, field, value, confidence), a row per field of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions import scores as sc
from dossierlake.functions import validation as v


def heal(rows: DataFrame) -> DataFrame:
    """(id, field, original, value, confidence, validated, repaired, strategy): a value that can't be right goes, one that was misread is mended."""
    field, given, sure = F.col("field"), F.col("value"), F.col("confidence")
    x = rows.withColumn("unreal", v.hallucinated(field, given, sure))
    mend = ~F.col("unreal") & field.isin(*v.NUMBERS) & given.isNotNull()
    x = x.withColumn("mended", F.when(mend, v.repaired_number(field, given)).otherwise(given))
    x = x.withColumn("repaired", F.coalesce(mend & (F.col("mended") != F.trim(given)), F.lit(False)))
    x = x.withColumn("validated", ~F.col("unreal") & v.valid_value(field, F.col("mended"), sure))
    confidence = sc.recalibrated(sure, F.col("validated"), F.col("repaired"), F.lit(0))
    return x.select("id", "field", given.alias("original"), F.when(F.col("validated"), F.col("mended")).alias("value"), confidence.alias("confidence"), "validated", "repaired", F.lit("initial").alias("strategy"))


def _of(field: str, column: str = "value") -> Column:
    return F.max(F.when(F.col("field") == field, F.col(column)))


def recover(healed: DataFrame) -> DataFrame:
    """Percentages that are missing or invalid, worked out from valid marks, also where a document has no row for one."""
    document = Window.partitionBy("id")
    made = v.marks_percentage(_of("obtained_marks").over(document), _of("total_marks").over(document)).cast("string")
    x = healed.withColumn("made", made)
    take = (F.col("field") == "percentage") & F.col("made").isNotNull() & (F.col("value").isNull() | ~F.col("validated"))
    kept = x.select("id", "field", "original", F.when(take, F.col("made")).otherwise(F.col("value")).alias("value"), F.when(take, 0.99).otherwise(F.col("confidence")).alias("confidence"), (F.col("validated") | take).alias("validated"), (F.col("repaired") | take).alias("repaired"), F.when(take, "mathematical_recovery").otherwise(F.col("strategy")).alias("strategy"))
    marks = healed.groupBy("id").agg(v.marks_percentage(_of("obtained_marks"), _of("total_marks")).cast("string").alias("value"), F.bool_or(F.col("field") == "percentage").alias("has"))
    added = marks.where(~F.col("has") & F.col("value").isNotNull())
    return kept.unionByName(added.select("id", F.lit("percentage").alias("field"), F.lit(None).cast("string").alias("original"), "value", F.lit(0.99).alias("confidence"), F.lit(True).alias("validated"), F.lit(True).alias("repaired"), F.lit("mathematical_recovery").alias("strategy")))


def inconsistent(healed: DataFrame) -> DataFrame:
    """(id, warnings) of every document, by its values as they stand."""
    wide = healed.groupBy("id").agg(*[_of(f).alias(f) for f in ("percentage", "cgpa", "spi", "obtained_marks", "total_marks")])
    grade = F.coalesce("spi", "cgpa")
    return wide.select("id", v.consistency_warnings(F.col("percentage"), grade, F.col("obtained_marks"), F.col("total_marks")).alias("warnings"))
