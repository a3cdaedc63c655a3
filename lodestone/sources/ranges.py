"""Pages of a large table in the order of a key (R19): rows are kept in ranges of the key with their counts before each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RangedTable:
    """A table of ``schema`` in the folder ``path`` in ranges of the columns ``keys``, in ascending order, nulls first."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType

    @staticmethod
    def write(rows: DataFrame, path: str, *keys: str, rows_per_range: int = 1_000_000, most_small: int = 1000) -> RangedTable:
        """Deal ``rows`` out in ranges whose borders Spark samples, of about ``rows_per_range`` rows, and count each.

        Each range is a task and a folder, so there are up to ``most_small`` ranges of less than a million rows: a larger table
        has more rows in each, of which a page still reads one or two.

        ``keys`` should tell rows apart (add an id): rows that agree in all of them share a range.
        """
        spark = rows.sparkSession
        n = rows.count()
        n_ranges = max(1, min(-(-n // rows_per_range), max(most_small, -(-n // 1_000_000))))
        dealt = rows.repartitionByRange(n_ranges, *keys).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(f"{path}/rows")
        counts = spark.read.schema("_range int").parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
        counts.coalesce(1).write.parquet(f"{path}/counts")
        return RangedTable(spark, path, keys, rows.schema)

    def ranges(self) -> DataFrame:
        """``_range, n, before``: each range with its rows and those of all ranges before it, one row for each range."""
        counts = self.spark.read.schema("_range int, n long").parquet(f"{self.path}/counts")
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def page(self, skip: int, limit: int = 100) -> DataFrame:
        """Rows ``skip`` to ``skip + limit`` in the order of the keys. Only the ranges that hold them are read and sorted."""
        if skip < 0 or limit < 0:
            raise ValueError("skip and limit can't be negative")
        held = self.ranges().where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).orderBy("_range").collect()
        if not held or not limit:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/_range={r['_range']}" for r in held])
        return rows.orderBy(*self.keys).offset(skip - held[0]["before"]).limit(limit)
