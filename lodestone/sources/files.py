"""Reading of catalog files and submitted content, and the sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def read_catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred; a missing path gives an empty frame."""
    try:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string")


def normalize_intake(rows: DataFrame) -> DataFrame:
    """``mpn`` and ``title`` of batch rows whatever the spelling of their headers; rows with neither are dropped.

    A blank cell counts as none and falls through to the next header.
    """
    named = {c.strip().lower().replace("_", " "): c for c in reversed(rows.columns)}

    def first(*names: str) -> Column:
        found = [F.nullif(strip(F.col(f"`{named[n]}`").cast("string")), F.lit("")) for n in names if n in named]
        return F.coalesce(*found, F.lit(None).cast("string"))

    taken = {named[n] for n in ("sku", "mpn", "part number", "product title", "title") if n in named}
    rest = [c for c in rows.columns if c not in taken]
    out = rows.select(*[F.col(f"`{c}`") for c in rest], first("sku", "mpn", "part number").alias("mpn"), first("product title", "title").alias("title"))
    return out.where(F.col("mpn").isNotNull() | F.col("title").isNotNull())


def content_address(pages: DataFrame, content: str = "html", content_type: Column | None = None) -> DataFrame:
    """S3: key, kind and extension of fetched content; equal content has equal keys."""
    kind = F.when(F.lower(content_type if content_type is not None else F.lit("text/html")).contains("pdf"), "pdf").otherwise("html")
    return pages.withColumn("content_hash", F.substring(F.sha2(F.col(content), 256), 1, 16)).withColumn("kind", kind).withColumn("file_name", F.concat_ws(".", "content_hash", "kind"))


def register_source(submitted: DataFrame) -> DataFrame:
    """Source rows in processing, with the length of their content."""
    return submitted.select("source_id", "source_type", "source_url", "project_id", F.lit("processing").alias("status"), F.struct(F.length("content").alias("raw_length")).alias("metadata"))


def export_lines(products: DataFrame) -> DataFrame:
    """Published products as lines of SKU, brand, name and completeness."""
    rows = products.where(F.col("published_at").isNotNull())
    line = F.concat_ws(",", "product_code", F.coalesce("brand_name", F.lit("")), "product_name", F.concat(F.col("completeness_score").cast("string"), F.lit("%")))
    return rows.select("product_code", line.alias("line"))


def export_catalog_csv(products: DataFrame, path: str) -> None:
    """The same as a folder of quoted CSV files with headers; without any product a header of the first three columns."""
    rows = products.where(F.col("published_at").isNotNull())
    if rows.isEmpty():
        products.sparkSession.createDataFrame([("SKU", "Brand", "Name")], "a string, b string, c string").coalesce(1).write.mode("overwrite").csv(path)
        return
    rows.select(F.col("product_code").alias("SKU"), F.col("brand_name").alias("Brand"), F.col("product_name").alias("Name"), F.concat(F.col("completeness_score").cast("string"), F.lit("%")).alias("Completeness")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def batch_result_sheet(rows: DataFrame, attributes: DataFrame, sources: DataFrame, names: list[str]) -> DataFrame:
    """One wide row for each of ``rows(row_no, mpn, title, ready, confidence)`` with a column for each named attribute.

    ``attributes(row_no, attribute, value)``; ``sources(row_no, source_pos, url)``.
    """
    wide = attributes.groupBy("row_no").pivot("attribute", names).agg(F.min("value"))
    urls = sources.groupBy("row_no").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("source_pos", "url"))).alias("u"))
    out = rows.join(urls, "row_no", "left").join(wide, "row_no", "left")
    return out.select(
        "row_no", F.col("mpn").alias("input_sku"), F.col("title").alias("input_title"), F.col("ready").alias("ready_for_publish"), "confidence",
        F.coalesce("n", F.lit(0)).alias("sources_count"), F.coalesce(F.array_join(F.transform("u", lambda s: s["url"]), "\n"), F.lit("No sources found")).alias("source_urls"), *names,
    )


def batch_status(rows: DataFrame) -> DataFrame:
    """State and progress of each batch of ``rows(batch_id, skipped, done)``; all rows count, skipped ones are not done."""
    n, k = F.count("*"), F.count_if(F.col("done") & ~F.col("skipped"))
    open_rows = F.count_if(~F.col("done") & ~F.col("skipped"))
    status = F.when(k == 0, "queued").when(open_rows == 0, "completed").otherwise("processing")
    return rows.groupBy("batch_id").agg(status.alias("status"), F.when(status == "completed", "100%").otherwise(F.format_string("%d/%d", k, n)).alias("progress"))


def write_snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table written as Parquet; ``append`` adds to it."""
    df.write.mode(mode).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table read back, with a fixed schema if given."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
