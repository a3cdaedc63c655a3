"""Compositions: from identifiers and search results to golden records, in batch and for submitted sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cleaning, extract, golden, markup
from lodestone.operators import standardize as st
from lodestone.sources import selection
from lodestone.storage import dealt, written


def aggregate_products(
    identifiers: DataFrame, results: DataFrame, pages: DataFrame, synonyms: DataFrame, rules: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = written, store: str | None = None, parse: Callable[[str], markup.Page] = markup.Page,
) -> tuple[DataFrame, DataFrame]:
    """Golden records of ``identifiers(product_key, mpn, title)`` and their standardized attributes.

    Sources are chosen among ``results(product_key, result_rank, url, fetched)``, extracted from ``pages(url, page_id,
    html)``, unified, standardized and built into records. A product without an extracted source has status ``failed``;
    ``reason`` says why: none chosen, nothing found, or ``extraction_failed`` if ``parse`` failed on all of its pages.
    ``cut`` writes down what is used several times, so that pages are parsed once. With ``store``, results of extraction are
    kept there by content, and pages that were seen before aren't parsed again.
    """
    chosen = selection.select_sources(results)
    used = pages.join(dealt(chosen.select("url").distinct()), "url", "left_semi").where(~extract.too_short())
    found = extract.extract_by_content(used, store, parse) if store else extract.fallback_extraction(used, mark=True, parse=parse)
    pages_of = used.select("page_id", "url").join(dealt(chosen), "url").select("page_id", "product_key", "source_pos")
    found = cut(found.join(dealt(pages_of), "page_id").select("product_key", "source_pos", "label", "value", "strategy"))
    extracted = found.where("label is not null").select("product_key", "source_pos", "label", "value", F.lit("web").alias("source"))
    unified = st.unify_attributes(extracted, synonyms)
    done = cut(st.standardize(st.gather_canonical_values(extracted, unified), rules).where("status = 'ok'"))
    named = golden.derive_identifiers(identifiers).select("product_key", F.nullif("mpn", F.lit("")).alias("sku"), F.nullif("brand", F.lit("")).alias("brand"))
    records = golden.build_golden_record(named, done).join(dealt(selection.sources_used(chosen)), "product_key", "left")
    failed = found.where(F.col("strategy") == markup.FAILED).groupBy("product_key").agg(F.bool_and(F.col("value").isNotNull()).alias("all_failed"))
    status = F.when(F.col("n_attributes") == 0, "failed").otherwise("success")
    reason = F.when(F.col("n_attributes") > 0, F.lit(None)).when(F.col("sources_used") == 0, "no_sources").when(F.col("all_failed"), "extraction_failed").otherwise("nothing_found")
    records = records.withColumn("sources_used", F.coalesce("sources_used", F.lit(0))).join(dealt(failed), "product_key", "left")
    return records.withColumn("status", status).withColumn("reason", reason).drop("all_failed"), done


@dataclass
class Catalog:
    """Snapshots that the ingestion of sources reads and gives anew."""

    products: DataFrame
    issues: DataFrame
    audit: DataFrame
    priorities: DataFrame
    sources: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Catalog:
        frame = lambda schema: spark.createDataFrame([], schema)
        return Catalog(
            frame("product_code string, product_name string, brand_name string, enrichment_status string, completeness_score int"),
            frame("product_code string, attribute string, issue_type string, details string, resolved boolean"),
            frame("product_id string, stage string, sources_used string"),
            frame("project_id string, source_id long, priority_rank int, reliability_score double"),
            frame("source_id long, source_type string, source_url string, project_id string, status string, raw_length int"),
        )


@dataclass
class Web:
    """What the aggregation of submitted sources reads besides them; ``results`` are keyed by the code of a product.

    ``store`` keeps results of extraction by content, ``parse`` reads a page.
    """

    results: DataFrame
    pages: DataFrame
    synonyms: DataFrame
    rules: DataFrame
    store: str | None = None
    parse: Callable[[str], markup.Page] = markup.Page


def ingest_changes(submitted: DataFrame, catalog: Catalog, web: Web, cut: Callable[[DataFrame], DataFrame] = written) -> Catalog:
    """What submitted key-value texts add to each table; ``products`` holds the new state of those that change.

    A source names a product by its text. That product is aggregated (G5) from the web; if it succeeds, its attributes
    give the issues and the score of completeness. A source is completed even if the aggregation finds nothing, and failed if
    all pages of its product fail; the others of the batch go on. Of several texts
    for a product the one with the largest source id names it, of several for a source id the first by text. A source
    that is already completed is left out, so that a rerun changes nothing.
    """
    one = submitted.groupBy("source_id").agg(F.min_by(F.struct("source_type", "source_url", "project_id", "content"), "content").alias("s")).select("source_id", "s.*")
    new = one.join(dealt(catalog.sources.where("status = 'completed'").select("source_id")), "source_id", "left_anti")
    who = extract.product_of_text(extract.parse_key_value_text(new))
    known = cut(new.select("source_id", "source_type", "source_url", "project_id", F.length("content").alias("raw_length")).join(dealt(who), "source_id", "left"))
    named = known.where("sku is not null").groupBy("sku").agg(F.max_by(F.struct("title", "brand"), "source_id").alias("t"))
    named = named.select(F.col("sku").alias("product_key"), F.col("sku").alias("mpn"), "t.title", "t.brand")
    results = web.results.join(dealt(named.select("product_key")), "product_key", "left_semi")
    records, done = aggregate_products(named, results, web.pages, web.synonyms, web.rules, cut, web.store, web.parse)
    records = cut(records)
    counts = records.where("status = 'success'").select("product_key", F.col("n_attributes").cast("int").alias("n_attributes"))
    found = named.join(dealt(counts), "product_key").select(F.col("product_key").alias("product_code"), "title", "brand", "n_attributes")
    value = F.coalesce("standard_value", F.col("standard_number").cast("string"))
    issues = cleaning.detect_issues(done.select(F.col("product_key").alias("product_code"), "attribute", value.alias("value")))
    failed = records.where("reason = 'extraction_failed'").select(F.col("product_key").alias("sku")).distinct().withColumn("failed", F.lit(True))
    broken = known.join(dealt(failed), "sku", "left")
    begun = known.select("source_id", "source_type", "source_url", "project_id", F.lit("processing").alias("status"), "raw_length")
    return Catalog(
        golden.upsert_product(catalog.products.join(dealt(found.select("product_code")), "product_code", "left_semi"), found),
        issues,
        golden.append_audit(catalog.audit.limit(0), known.select("sku", "source_url")),
        golden.insert_source_priority(catalog.priorities.limit(0), known.join(dealt(catalog.priorities.select("source_id")), "source_id", "left_anti")),
        golden.update_source_status(begun, broken.select("source_id", F.coalesce("failed", F.lit(False)).alias("failed"))),
    )


def ingest_sources(submitted: DataFrame, catalog: Catalog, web: Web) -> Catalog:
    """The tables after the submitted sources."""
    new = ingest_changes(submitted, catalog, web)
    over = lambda old, rows, key: old.join(dealt(rows.select(key)), key, "left_anti").unionByName(rows)
    return Catalog(
        over(catalog.products, new.products, "product_code"),
        catalog.issues.unionByName(new.issues),
        catalog.audit.unionByName(new.audit),
        catalog.priorities.unionByName(new.priorities),
        over(catalog.sources, new.sources, "source_id"),
    )
