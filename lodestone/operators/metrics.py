"""Metrics of tables in buckets (R4, R9, R10): states of buckets are kept and merged, so a change costs its buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.keyed import KeyedTable


def source_metrics(sources: DataFrame, extractions: KeyedTable) -> DataFrame:
    """R4 as ``catalog.source_metrics`` gives it, from ``extractions(source_id, confidence, attributes map, ...)``.

    The number of different labels comes from mergeable sketches: exact for a few hundred labels of a source, beyond that
    within about 2 % (a standard error); all else is exact.
    """
    exploded = lambda df: df.select("bucket", "source_id", "confidence", F.posexplode_outer(F.map_keys("attributes")).alias("pos", "label"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    partial = {"n": F.count_if(first & F.col("confidence").isNotNull()), "total": F.sum(F.when(first, F.col("confidence"))), "labels": F.hll_sketch_agg("label", F.lit(12))}
    merged = {"c": F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), "n_attributes": F.hll_sketch_estimate(F.hll_union_agg("labels", F.lit(False)))}
    found = extractions.aggregate("source_metrics", partial, merged, ("source_id",), exploded)
    n = F.coalesce("n_attributes", F.lit(0))
    return sources.select("source_id").join(found, "source_id", "left").select(
        "source_id", F.round(F.coalesce("c", F.lit(0.0)), 2).alias("avg_confidence"), n.alias("n_attributes"), F.round(F.least(n / 20.0, F.lit(1.0)), 2).alias("completeness")
    )


def product_metrics(products: KeyedTable) -> DataFrame:
    """R9, the part on products: ``total_products, published_products, catalog_health``, exact, in one row."""
    partial = {"n": F.count("*"), "published": F.count("published_at"), "scored": F.count("completeness_score"), "score": F.sum(F.col("completeness_score").cast("long"))}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = F.coalesce(F.sum("score") / F.nullif(F.sum("scored"), F.lit(0)), F.lit(0)).cast("int")
    return products.aggregate("product_metrics", partial, {"total_products": total("n"), "published_products": total("published"), "catalog_health": mean})


def review_stats(items: KeyedTable) -> DataFrame:
    """Counts by status, exact, in one row."""
    names = ("pending", "approved", "rejected")
    partial = {"total": F.count("*")} | {s: F.count_if(F.col("status") == s) for s in names}
    merged = {s: F.coalesce(F.sum(s), F.lit(0)) for s in ("total", *names)}
    return items.aggregate("review_stats", partial, merged).withColumn("in_review", F.lit(0).cast("long"))
