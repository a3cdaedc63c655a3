"""The corpus pipeline: its stages chain, take effect, and end in the packing of what is left."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import id_bucket

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line rlike '[^\\\\s]'")
    assert lines.count() == lines.distinct().count()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == want


def test_language_stage_rejects_mixtures_and_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = {k: docs.where((F.col("lang") == k) & (F.length("text") > 900)).orderBy("doc_id").first().text for k in ("de", "en", "es", "fr")}
    draw = random.Random(5)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(3, 10)))
    planted = {
        "four": " ".join(p[:400] for p in part.values()), "two": part["en"][:600] + " " + part["de"][:600],
        "junk": " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), "few": " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(8)),
        "script": " ".join(word("абвгдежзиклмнопрстуф") for _ in range(100)), "none": "12 34 !",
    }
    rows = spark.createDataFrame([(-1 - i, t, k) for i, (k, t) in enumerate(planted.items())], "doc_id long, text string, source string")
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = corpus_pipeline.language_id(spark, docs.union(rows), SF)
    assert [r.source for r in kept.where("doc_id < 0").collect()] == []
    held_out = id_bucket("doc_id", 4) == 2
    assert kept.where(held_out & (F.col("doc_id") >= 0)).count() == docs.where(held_out).count()
