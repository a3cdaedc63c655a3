"""A training corpus from documents: each stage applies one operator to all that the one before it kept.

For all stages: columns besides ``doc_id``, ``text``, ``lang`` and ``n_chars`` pass untouched, whatever their names; empty
tables are valid; ids may be null or repeated, since each row counts for itself. Null and empty texts have no language, so
the first stage drops them; the later stages by themselves keep a null text as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_packing, op2_language, op3_simhash, op4_decontaminate, op5_lines
from lodestone.llm.common import durable, id_bucket, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a language that they are mostly in, or that fit no language (letter junk), go."""
    return op2_language.keep_identified(docs, op2_language.train(docs.where(id_bucket("doc_id", 4) != 2)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents that lose all their words by it; a column ``n_chars`` follows."""
    out = op5_lines.dedup_lines(docs, n_lines="__n_lines", n_removed="__n_removed")
    out = out.where("__n_removed = 0 or text rlike '[^\\\\s]'")
    changed = F.when(F.col("__n_removed") > 0, F.length("text").cast("long"))
    return out.select(*[F.coalesce(changed, c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, null ids last, then by a hash of the text."""
    return op3_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of benchmark items go."""
    return op4_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the last stage, so its columns are the packing's own."""
    return op1_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL can't express the language model and the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the rows between two stages are written to the checkpoint folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = durable(docs) if k + 1 < len(STAGES) else docs
    return docs
