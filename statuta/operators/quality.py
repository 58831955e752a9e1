"""Checks of records: required fields, domains, keys, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that a record must have.
REQUIRED = ("doc_id", "doc_title", "doc_form", "doc_number", "doc_year")


def issues(required: tuple[str, ...] = REQUIRED) -> Column:
    """Array of (field, severity, message), one for each required field that is null or blank."""
    found = [F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.struct(F.lit(f).alias("field"), F.lit("error").alias("severity"), F.lit("required field is missing").alias("message"))) for f in required]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def validate(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df`` with its issues, their number and is_valid (no error among them)."""
    out = df.withColumn("issues", issues(required))
    return out.withColumn("n_issues", F.size("issues")).withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def validation_id(form: Column, number: Column, year: Column) -> Column:
    return F.lower(F.concat_ws("_", form, number, year))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
