"""Enrichment texts of products: input, validation, use cases, upsert and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.schemas import ENRICHMENT, ENRICHMENT_REVIEW_BELOW
from lodestone.sources.keyed import one_per_key


def enrichment_input(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Brand and category with defaults, and the attributes as JSON with sorted keys; of several values the least."""
    single = attributes.where("attribute is not null").groupBy("product_code", "attribute").agg(F.min("value").alias("value"))
    pairs = single.groupBy("product_code").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("attribute", "value")))).alias("a"))
    rows = products.join(pairs, "product_code", "left")
    default = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    return rows.select("product_code", default("brand_name", "Generic").alias("brand"), default("category_1", "Product").alias("category"), F.coalesce(F.to_json("a"), F.lit("{}")).alias("attributes"))


def validate_enrichment(responses: DataFrame, column: str = "content") -> DataFrame:
    """Whether a JSON text is an enrichment: 5 bullets under 100 characters, 5 to 10 tags, 2 to 4 use cases, a confidence
    from 0 to 1, a title of 80 characters at most if any, and no other keys."""
    e = F.from_json(column, ENRICHMENT)
    keys = F.json_object_keys(F.when(F.try_parse_json(column).isNotNull(), F.col(column)))
    known = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in ENRICHMENT.fields]))) == 0
    ok = (
        (F.size(e["bullets"]) == 5) & ~F.exists(e["bullets"], lambda b: F.length(b) >= 100) & F.size(e["tags"]).between(5, 10)
        & F.size(e["use_cases"]).between(2, 4) & e["confidence"].between(0, 1) & (F.coalesce(F.length(e["seo_title"]), F.lit(0)) <= 80) & known
    )
    return responses.withColumn("valid", F.coalesce(ok, F.lit(False)))


def use_case_map(use_cases: Column) -> Column:
    """Use cases as a map numbered from 1."""
    return F.map_from_entries(F.transform(use_cases, lambda x, i: F.struct(F.concat(F.lit("Use Case "), (i + 1).cast("string")), x)))


def upsert_enrichment(enrichments: DataFrame, incoming: DataFrame, products: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Incoming rows by product over the current ones; their products are completed.

    Of several incoming rows for a product the last by ``order`` stays, then by the values of its columns.
    """
    incoming = one_per_key(incoming, "product_id", order)
    out = enrichments.join(incoming.select("product_id").distinct(), "product_id", "left_anti").unionByName(incoming, allowMissingColumns=True)
    hit = incoming.select("product_id").distinct().withColumn("_hit", F.lit(True))
    done = products.join(hit, "product_id", "left").withColumn("enrichment_status", F.when(F.col("_hit"), "completed").otherwise(F.col("enrichment_status"))).drop("_hit")
    return out, done


def enrichment_review_flag(enrichments: DataFrame, below: float = ENRICHMENT_REVIEW_BELOW) -> DataFrame:
    """E5: whether an enrichment needs review."""
    return enrichments.withColumn("review_required", F.coalesce(F.col("confidence") < below, F.lit(True)))
