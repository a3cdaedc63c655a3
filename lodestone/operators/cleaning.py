"""Cleaning of observed values and detection of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_invalid, normalize_text


def clean_attribute(observations: DataFrame) -> DataFrame:
    """Status of each observation (valid, invalid, duplicate) and its normalized value.

    A value is a duplicate if an earlier valid one of the same product and attribute equals it but for case. The first
    of each value is found by an aggregate (partial before the shuffle) and joined back, so that a product with very
    many observations needs no single task.
    """
    keys = ["product_key", "attribute", "_low"]
    rows = observations.withColumn("normalized", normalize_text(F.col("value"))).withColumn("_low", F.lower("normalized"))
    first = rows.where(~is_invalid(F.col("normalized"))).groupBy(*keys).agg(F.min("pos").alias("_first"))
    joined = rows.join(first, keys, "left")
    status = F.when(is_invalid(F.col("normalized")), "invalid").when(F.col("pos") > F.col("_first"), "duplicate").otherwise("valid")
    return joined.select(*observations.columns, "normalized", status.alias("status"))


def removed_values(cleaned: DataFrame) -> DataFrame:
    """What cleaning removed, with the original value and the reason."""
    return cleaned.where("status <> 'valid'").select("product_key", "attribute", "pos", "value", "source", F.col("status").alias("reason"))


def issue_placeholder(attributes: DataFrame) -> DataFrame:
    """Attributes whose value is a placeholder."""
    return _issue(attributes.where(is_invalid(F.col("value"))), F.format_string("Placeholder detected: '%s'", F.coalesce("value", F.lit(""))))


def _priced(attributes: DataFrame) -> DataFrame:
    bare = F.trim(F.replace(F.replace("value", F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
    number = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    return attributes.where(F.lower("attribute").contains("price") & F.col("value").isNotNull()).withColumn("_number", number)


def issue_price_nonpositive(attributes: DataFrame) -> DataFrame:
    """Prices of zero or less."""
    return _issue(_priced(attributes).where("_number <= 0"), F.lit("Price must be a positive number"))


def issue_price_nonnumeric(attributes: DataFrame) -> DataFrame:
    """C11: prices that are no number."""
    return _issue(_priced(attributes).where("_number is null"), F.concat(F.lit("Non-numeric price found: "), "value"))


def _issue(rows: DataFrame, details) -> DataFrame:
    return rows.select("product_code", "attribute", F.lit("invalid").alias("issue_type"), details.alias("details"), F.lit(False).alias("resolved"))


def detect_issues(attributes: DataFrame) -> DataFrame:
    """All issues; a placeholder price has two."""
    return issue_placeholder(attributes).unionByName(issue_price_nonpositive(attributes)).unionByName(issue_price_nonnumeric(attributes))
