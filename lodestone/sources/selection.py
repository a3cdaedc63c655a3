"""Choice of the sources of a product: queries, ranked links, the first that could be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.schemas import MAX_LINKS, MAX_QUERIES, MAX_SOURCES


def build_queries(identifiers: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """K1: search texts of each of ``identifiers(row_no, mpn, title)``."""
    texts = F.array(F.concat(F.coalesce("mpn", F.lit("")), F.lit(" datasheet pdf")), F.concat(F.coalesce("title", F.lit("")), F.lit(" specifications")))
    return identifiers.select("row_no", F.posexplode(F.slice(texts, 1, most)).alias("query_pos", "query"))


def rank_results(results: DataFrame, most: int = MAX_LINKS) -> DataFrame:
    """K2: the first links of each product, those without a URL left out."""
    w = Window.partitionBy("product_key").orderBy("result_rank")
    return results.where(F.col("url").isNotNull()).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def select_sources(results: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """K3: the first different links that could be fetched. The first use of a link is found by an aggregate."""
    first = results.groupBy("product_key", "url").agg(F.min(F.struct("result_rank", "fetched")).alias("f"))
    rows = first.select("product_key", "url", F.col("f.result_rank").alias("result_rank"), F.col("f.fetched").alias("fetched")).where("fetched")
    w = Window.partitionBy("product_key").orderBy("result_rank")
    return rows.withColumn("source_pos", F.row_number().over(w)).where(F.col("source_pos") <= most).drop("fetched")


def sources_used(selected: DataFrame) -> DataFrame:
    """K4: number of sources of each product."""
    return selected.groupBy("product_key").agg(F.count("*").alias("sources_used"))
