"""Golden records and the catalog writes that follow an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.keyed import one_per_key
from lodestone.storage import dealt


def derive_identifiers(rows: DataFrame) -> DataFrame:
    """G1: identifiers default to empty; the brand is the first word of the title."""
    title = F.coalesce("title", F.lit(""))
    brand = F.regexp_extract(title, r"(?U)^\s*(\S+)", 1)
    return rows.withColumn("mpn", F.coalesce("mpn", F.lit(""))).withColumn("title", title).withColumn("brand", brand)


def request_id(mpn: Column, title: Column, at: Column) -> Column:
    """Twelve hexadecimal digits of a request."""
    return F.substring(F.sha2(F.concat(F.coalesce(mpn, F.lit("")), F.coalesce(title, F.lit("")), at), 256), 1, 12)


def build_golden_record(products: DataFrame, specs: DataFrame) -> DataFrame:
    """A record for each of ``products(product_key, sku, brand)`` from ``specs(product_key, attribute, ...)``.

    Ready with a brand and four attributes; confidence 0.7 with five, else 0.5. Products without identifiers or
    attributes stay, with an error.
    """
    n = specs.groupBy("product_key").agg(F.countDistinct("attribute").alias("n"))
    rows = products.join(dealt(n), "product_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    branded = F.coalesce("brand", F.lit("")) != ""
    error = F.when(F.col("sku").isNull() & F.col("brand").isNull(), "missing_identifiers").when(F.col("n") == 0, "no_standardized_data")
    return rows.select(
        "product_key", F.coalesce("sku", F.lit("UNKNOWN")).alias("sku"), F.coalesce("brand", F.lit("UNKNOWN")).alias("brand"), F.col("n").alias("n_attributes"),
        (error.isNull() & branded & (F.col("n") >= 4)).alias("ready_for_publish"),
        F.when(error.isNull(), F.when(F.col("n") >= 5, 0.7).otherwise(0.5)).alias("confidence"), error.alias("error"),
    )


PROPOSAL = "error string, sku string, brand string, attributes map<string,string>, ready_for_publish boolean, identifiers string, standardized_attributes string, product_attributes string"


def validate_golden(proposals: DataFrame, column: str = "content") -> DataFrame:
    """Whether a proposed record (JSON text) may stand; otherwise the deterministic one does."""
    p = F.from_json(column, PROPOSAL)
    nested = F.coalesce(p["identifiers"], p["standardized_attributes"], p["product_attributes"]).isNotNull()
    complete = p["sku"].isNotNull() & p["brand"].isNotNull() & p["ready_for_publish"].isNotNull() & (F.coalesce(F.size(p["attributes"]), F.lit(0)) > 0)
    return proposals.withColumn("valid", F.coalesce(complete & p["error"].isNull() & ~nested, F.lit(False)))


def completeness_score(n_attributes: Column) -> Column:
    """Five points for each attribute, 100 at most."""
    return F.least(n_attributes * 5, F.lit(100)).cast("int")


def upsert_product(products: DataFrame, found: DataFrame) -> DataFrame:
    """``found(product_code, title, brand, n_attributes)`` over ``products``: existing ones completed, others added.

    Of several rows of ``found`` for a product the one of the largest title counts, then by brand and attributes.
    """
    found = one_per_key(found.select("product_code", "title", "brand", "n_attributes"), "product_code")
    joined = products.join(found, "product_code", "full_outer")
    hit = F.col("n_attributes").isNotNull()
    return joined.select(
        "product_code", F.coalesce("product_name", F.coalesce("title", "product_code")).alias("product_name"), F.coalesce("brand_name", F.when(F.col("product_name").isNull(), F.col("brand"))).alias("brand_name"),
        F.when(hit, "completed").otherwise(F.col("enrichment_status")).alias("enrichment_status"),
        F.when(hit, completeness_score(F.col("n_attributes"))).otherwise(F.col("completeness_score")).alias("completeness_score"),
    )


def append_audit(audit: DataFrame, runs: DataFrame) -> DataFrame:
    """An audit row for each run of ``runs(sku, source_url)``."""
    rows = runs.select(
        F.coalesce(F.nullif("sku", F.lit("")), F.lit("unknown")).alias("product_id"), F.lit("extraction").alias("stage"),
        F.coalesce(F.nullif("source_url", F.lit("")), F.lit("Manual Input")).alias("sources_used"),
    )
    return audit.unionByName(rows, allowMissingColumns=True)


def insert_source_priority(priorities: DataFrame, sources: DataFrame) -> DataFrame:
    """A priority for each source without one."""
    fresh = sources.join(dealt(priorities.select("source_id").distinct()), "source_id", "left_anti").dropDuplicates(["source_id"])
    return priorities.unionByName(fresh.select(
        F.coalesce("project_id", F.lit("default-project")).alias("project_id"), "source_id", F.lit(1).alias("priority_rank"),
        F.when(F.col("source_type") == "pdf", 0.9).otherwise(0.7).alias("reliability_score"),
    ))


def update_source_status(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with a run in ``runs(source_id, failed)`` are completed or failed."""
    joined = sources.join(dealt(runs.select("source_id", "failed")), "source_id", "left")
    return joined.withColumn("status", F.when(F.col("failed").isNull(), F.col("status")).when(F.col("failed"), "failed").otherwise("completed")).drop("failed")
