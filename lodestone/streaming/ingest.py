"""Submitted sources as a stream: each batch goes through the ingestion and adds its changes to a folder."""

from __future__ import annotations

from dataclasses import fields, replace
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.plans.aggregate import Catalog, Web, ingest_changes
from lodestone.schemas import SOURCE_SUBMISSION
from lodestone.sources.files import register_source
from lodestone.sources.keyed import KeyedTable

#: Tables with a row for each key, and those that batches add rows to.
_KEYED = {"products": "product_code", "sources": "source_id", "priorities": "source_id"}
_ADDED = [f.name for f in fields(Catalog) if f.name not in _KEYED]


def keyed(spark: SparkSession, folder: str, table: str) -> KeyedTable:
    """The products, sources or priorities of a folder, in buckets of their keys."""
    return KeyedTable(spark, f"{folder}/{table}", _KEYED[table], getattr(Catalog.empty(spark), table).schema)


def added(spark: SparkSession, folder: str, table: str, version: int) -> DataFrame:
    """The rows that the batches up to ``version`` added to a table."""
    schema = getattr(Catalog.empty(spark), table).schema
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/{table}").where(F.col("batch") <= version).drop("batch")


def read_catalog(spark: SparkSession, folder: str, version: int) -> Catalog:
    """All tables after batch ``version``; empty ones below zero."""
    if version < 0:
        return Catalog.empty(spark)
    rows = {t: added(spark, folder, t, version) for t in _ADDED}
    return Catalog(**rows, **{t: keyed(spark, folder, t).read(version) for t in _KEYED})


def catalog_of(batch: DataFrame, folder: str, version: int) -> Catalog:
    """What a batch can change or has to know of the catalog: the buckets of its sources and of the products that they name."""
    spark = batch.sparkSession
    if version < 0:
        return Catalog.empty(spark)
    codes = extract.product_of_text(extract.parse_key_value_text(batch)).where("sku is not null").select("sku")
    rows = {t: keyed(spark, folder, t).of_keys(batch, as_of=version) for t in ("sources", "priorities")}
    return replace(Catalog.empty(spark), products=keyed(spark, folder, "products").of_keys(codes, "sku", version), **rows)


def source_states(spark: SparkSession, folder: str) -> DataFrame:
    """``source_id, status`` of all that was submitted: completed, failed, or in processing where its batch has not ended."""
    done = read_catalog(spark, folder, latest_version(spark, folder)).sources.select("source_id", "status")
    begun = spark.read.schema("source_id long, status string").parquet(f"{folder}/registered").select("source_id", "status").distinct()
    return done.unionByName(begun.join(done, "source_id", "left_anti"))


def latest_version(spark: SparkSession, folder: str) -> int:
    """The last version whose pointer was written, -1 without any."""
    try:
        return spark.read.parquet(f"{folder}/versions").selectExpr("max(version)").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def ingest_batch(batch: DataFrame, batch_id: int, folder: str, web: Web) -> None:
    """One batch: its sources are registered, then its changes are written, and the pointer last.

    A batch that ran before changes nothing. A source whose pages all fail is failed and the others go on; it is done again
    when it is submitted again. A batch that fails as a whole (a table can't be read) stops the stream; its sources stay in
    processing, and a restart does the whole batch again over what it had written. A batch reads and writes the buckets that its
    sources and products fall in, and adds its rows to the other tables, so history costs nothing. Pages are parsed once by content, kept in
    the folder, unless the web names another store.
    """
    spark = batch.sparkSession
    version = latest_version(spark, folder)
    if version >= batch_id:
        return
    register_source(batch).select("source_id", "status").write.mode("overwrite").parquet(f"{folder}/registered/batch={batch_id}")
    parts = count()

    def cut(df: DataFrame) -> DataFrame:
        path = f"{folder}/work/batch={batch_id}/part={next(parts)}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).option("basePath", path).parquet(path)

    web = replace(web, store=web.store or f"{folder}/extracted")
    changes = ingest_changes(batch, catalog_of(batch, folder, version), web, cut)
    for t in _ADDED:
        getattr(changes, t).write.mode("overwrite").parquet(f"{folder}/{t}/batch={batch_id}")
    for t, key in _KEYED.items():
        put = lambda old, new, key=key: old.join(new.select(key), key, "left_anti").unionByName(new)
        keyed(spark, folder, t).update(cut(getattr(changes, t)), put, batch_id)
    spark.createDataFrame([(batch_id,)], "version long").write.mode("append").parquet(f"{folder}/versions")


def ingest_stream(spark: SparkSession, submissions: str, folder: str, web: Web, files_per_batch: int = 1) -> DataFrame:
    """All submissions that have arrived in a folder of Parquet files; returns the products after them.

    The checkpoint and the versions make a restart safe: a batch is applied once, and a source twice changes nothing. At the
    end, data that later batches replaced is deleted.
    """
    stream = spark.readStream.schema(SOURCE_SUBMISSION).option("maxFilesPerTrigger", files_per_batch).parquet(submissions)
    run = (
        stream.writeStream.foreachBatch(lambda batch, k: ingest_batch(batch, k, folder, web))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    for t in _KEYED:
        keyed(spark, folder, t).vacuum()
    return read_catalog(spark, folder, latest_version(spark, folder)).products
