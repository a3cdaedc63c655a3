"""Benchmark decontamination [native]: a prefix-filtered join on the rarest word of each window, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, table

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), "")


def lower_ascii(word: Column) -> Column:
    """A-Z to a-z, nothing else; most words are in lower case as they are."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows (words, their count, and the items that have them)."""
    words = F.transform(raw_words(F.col(text_col)), lower_ascii)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return (
        items.select(F.col(item_col).cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(F.transform(at, lambda i: F.slice("words", i, size))).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items"))
    )


def document_words(docs: DataFrame, words: str, *keep: str) -> DataFrame:
    """Every word of an array column with its position from 0; all its letters in lower case, which is enough for a key."""
    return docs.select(*keep, F.posexplode(words).alias("pos", "raw")).withColumn("word", F.lower("raw")).drop("raw")


def chunks_of(texts: DataFrame, size: int, core: int = 256) -> DataFrame:
    """Words of each document in chunks of ``core`` words with the ``size - 1`` words around them.

    Whatever is carried with a word is then a chunk, however long the document is.
    """
    first = lambda c: F.greatest(F.lit(0), c * core - (size - 1))
    count = F.ceil(F.size("words") / core).cast("int")
    chunk = lambda c: F.struct(c.alias("chunk"), first(c).alias("first"), F.slice("words", first(c) + 1, core + 2 * (size - 1)).alias("around"))
    chunks = F.transform(F.sequence(F.lit(0), count - 1), chunk)
    rows = texts.where(F.size("words") > 0).select("id", "text_hash", F.size("words").alias("n_words"), F.explode(chunks).alias("c"))
    return rows.select("id", "text_hash", "n_words", "c.chunk", "c.first", "c.around")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 13, min_share_inverse: int = 20, broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row for each row of ``docs``: its words, those inside occurrences of benchmark windows, and the items hit.

    The words of a window are ordered by their frequency in all documents. A document with the window must have its
    rarest word, so that word alone is joined; the window must then fit around the word (position and length), and its
    words must equal the document's there. Frequencies and candidates come from whole documents.

    The words that are joined are broadcast up to ``broadcast_rows`` of them; above that both joins shuffle, and the
    windows are verified after a join on the document. Null and empty texts have no words and are clean; items without
    words count nowhere; repeated documents and items stay; empty tables are valid; an id may be null.
    """
    windows = durable(windows_of(items, item_col, item_text_col, size))
    vocabulary = windows.select(F.explode("window").alias("w")).select(F.lower("w").alias("word")).distinct()
    few = windows.count() <= broadcast_rows and vocabulary.count() <= broadcast_rows
    hint = F.broadcast if few else (lambda df: df)

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), raw_words(F.col(text_col)).alias("words"))
    counts = durable(document_words(texts, "words").drop("pos").join(hint(vocabulary), "word").groupBy("word").count())
    rank = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "word", "offset")
    prefix = (
        windows.select("window", "items", F.posexplode("window").alias("offset", "w")).withColumn("word", F.lower("w")).drop("w")
        .join(counts, "word", "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1 and count > 0")
        .select("word", "offset", "window", "items")
    )
    prefix = durable(prefix)
    core = 256
    chunks = chunks_of(texts, size, core)
    at = F.col("first") + F.col("pos")
    start = at - F.col("offset")
    length = F.size("window")
    inside = (at >= F.col("chunk") * core) & (at < (F.col("chunk") + 1) * core)
    fits = inside & (start >= 0) & (start + length <= F.col("n_words"))
    same = F.transform(F.slice("around", start - F.col("first") + 1, length), lower_ascii) == F.col("window")
    keys = ["id", "text_hash", "n_words", "chunk", "first"]
    if few:
        hits = document_words(chunks, "around", *keys, "around").join(hint(prefix), "word").where(fits).where(same)
    else:
        candidates = document_words(chunks, "around", *keys).join(prefix, "word").where(fits)
        back = chunks.dropDuplicates(["id", "text_hash", "chunk"]).select(F.col("id").alias("bid"), F.col("text_hash").alias("bhash"), F.col("chunk").alias("bchunk"), "around")
        hits = candidates.join(back, F.col("id").eqNullSafe(F.col("bid")) & (F.col("text_hash") == F.col("bhash")) & (F.col("chunk") == F.col("bchunk"))).where(same)
    hits = hits.select("id", "text_hash", start.alias("start"), (start + length).alias("end"), "items").dropDuplicates(["id", "text_hash", "start", "end"])

    before = Window.partitionBy("id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    found = hits.withColumn("covered", covered).groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        F.sum("covered").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    out = texts.select("id", "text_hash", F.size("words").cast("long").alias("n_words")).join(
        durable(found), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left"
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (min_share_inverse * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; their rows and columns are as they were."""
    bad = decontaminate(docs, items, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(text_col) == F.col("__bad_hash")), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i : i + 12] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT row_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n) x),
hits AS (SELECT row_id, item, i, n FROM places JOIN windows USING (win)),
covered AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hits) x GROUP BY 1),
found AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (row_id) LEFT JOIN found USING (row_id)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE = {"op4_decontaminate": SQL}
