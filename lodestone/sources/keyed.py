"""Tables with one row for each key, in hash buckets: a small change reads and writes the buckets of its keys alone.

A version of a table is a list of its buckets with the version that wrote each, written last, so a reader sees a change
whole or not at all. Data of a bucket is never rewritten in place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_per_key(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``, then by all columns that can be ordered; a null key is a key."""
    sortable = [c for c in rows.columns if c != key and not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    by = [F.desc_nulls_last(c) for c in [*(order or []), *sortable]] or [F.lit(1)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class KeyedTable:
    """A table of ``schema`` in the folder ``path``, by ``key``. The number of buckets stays as it was first written."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    def _numbers(self, folder: str, name: str, written: bool = False) -> list[int]:
        """The numbers N of the folders ``name=N`` in a folder, only those whose writing has ended if ``written``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{name}=") and (not written or fs.exists(path(p, "_SUCCESS"))))

    def version(self, as_of: int | None = None) -> int:
        """The last version, or the last up to ``as_of``; -1 without any."""
        return max((v for v in self._numbers("versions", "version", written=True) if as_of is None or v <= as_of), default=-1)

    def manifest(self, as_of: int | None = None) -> dict[int, int]:
        """The version that each bucket was last written in; one row for each bucket is read."""
        v = self.version(as_of)
        if v < 0:
            return {}
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.path}/versions/version={v}")
        return {r.bucket: r.written for r in rows.where("bucket >= 0").collect()}

    def read(self, as_of: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, as of a version."""
        return self._read(self.manifest(as_of), only)

    def _read(self, manifest: dict[int, int], only: set[int] | None) -> DataFrame:
        places = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame, column: str | None = None) -> set[int]:
        """Buckets of the keys in ``keys``; as many numbers as there are buckets at most."""
        return {r.b for r in keys.select(self.bucket(column or self.key).alias("b")).distinct().collect()}

    def of_keys(self, keys: DataFrame, column: str | None = None, as_of: int | None = None) -> DataFrame:
        """The rows of the buckets that ``keys`` fall in."""
        return self.read(as_of, self.touched(keys, column))

    def get(self, value, as_of: int | None = None) -> DataFrame:
        """The row of a key, from one bucket."""
        typed = F.lit(value).cast(self.schema[self.key].dataType)
        b = self.spark.range(1).select(self.bucket(typed).alias("b")).first().b
        return self.read(as_of, {b}).where(F.col(self.key).eqNullSafe(typed))

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None, column: str | None = None) -> set[int]:
        """Write what ``merge(rows, changes)`` makes of the rows in the buckets of the changes' keys, and of no others.

        ``merge`` is any function over snapshots (R14, R22, R23, G8, E4); it has to give rows of the same buckets. A version
        that was begun before is done again over what it left. Gives the buckets that were written.
        """
        last = self.version() if version is None else version - 1
        touched = self.touched(changes, column)
        if not touched:
            return touched
        manifest = self.manifest(last)
        rows = merge(self._read(manifest, touched), changes).select(*self.schema.names)
        out = rows.withColumn("bucket", self.bucket(self.key))
        out.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/version={last + 1}")
        full = set(self._numbers(f"data/version={last + 1}", "bucket"))
        if not full <= touched:
            raise ValueError("the merge gave rows of other buckets")
        manifest = {b: v for b, v in manifest.items() if b not in touched} | {b: last + 1 for b in full}
        listed = list(manifest.items()) or [(-1, last + 1)]  # a table without rows still has the version
        self.spark.createDataFrame(listed, "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={last + 1}")
        return touched

    def aggregate(
        self, name: str, partial: dict[str, Column], merged: dict[str, Column], by: tuple[str, ...] = (), rows: Callable[[DataFrame], DataFrame] = lambda df: df
    ) -> DataFrame:
        """``by`` and the columns of ``merged``: an aggregate of the last version, from states of its buckets.

        ``partial`` makes the states from the rows of a bucket (after ``rows``, which may explode them), ``merged`` puts states
        together. States are kept under ``name`` with the version that wrote their bucket, so only buckets that changed since
        are read. Without ``by`` there is one row, of an empty table too. States of one name have to be made alike.
        """
        manifest, folder = self.manifest(), f"{self.path}/states/{name}"
        wanted = self.spark.createDataFrame(list(manifest.items()), "bucket int, written long")
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        known = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder))
        have = {(r.bucket, r.written) for r in self.spark.read.parquet(folder).select("bucket", "written").distinct().join(wanted, ["bucket", "written"]).collect()} if known else set()
        missing = {b for b, v in manifest.items() if (b, v) not in have}
        if missing or not known:
            changed = rows(self._read(manifest, missing).withColumn("bucket", self.bucket(self.key)))
            states = changed.groupBy("bucket", *by).agg(*[c.alias(n) for n, c in partial.items()])
            # A bucket without a group has a row all the same, so that it isn't read again.
            marks = wanted.where(F.col("bucket").isin(list(missing)))
            marks.join(states, "bucket", "left").withColumn("_empty", F.isnull(F.coalesce(*[F.col(n).cast("string") for n in partial]))).write.mode("append").parquet(folder)
        states = self.spark.read.parquet(folder).join(F.broadcast(wanted), ["bucket", "written"]).dropDuplicates(["bucket", "written", *by]).where("not _empty")
        return states.groupBy(*by).agg(*[c.alias(n) for n, c in merged.items()])

    def vacuum(self) -> int:
        """Delete data that the last version doesn't name, and older versions; gives the number of folders deleted."""
        kept, last = self.manifest(), self.version()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, gone = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for v in self._numbers("versions", "version"):
            if v < last:
                gone += fs.delete(path(f"{self.path}/versions/version={v}"), True)
        for v in self._numbers("data", "version"):
            for b in self._numbers(f"data/version={v}", "bucket"):
                if v <= last and kept.get(b) != v:
                    gone += fs.delete(path(f"{self.path}/data/version={v}/bucket={b}"), True)
        return gone
