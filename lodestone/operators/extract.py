"""Label and value pairs from pages and texts.

Every strategy gives long rows ``page_id, label, value, strategy, ord``. Those on markup come from one pass over its tags
(``markup``); the rest are native column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_text, strip
from lodestone.operators import markup as mk
from lodestone.schemas import DOCUMENT_CHARS, MIN_PAGE_CHARS
from lodestone.storage import dealt

#: Elements that are no main text.
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "svg", "noscript", "iframe")


def decode_entities(c: Column) -> Column:
    for entity, sign in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def html_main_text(html: Column) -> Column:
    """Text of the main element, or of the body, without scripts, navigation and the like."""
    kept = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED_TAGS)})\b.*?</\1\s*>", "")
    main = F.regexp_extract(kept, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1)
    body = F.regexp_extract(kept, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1)
    part = F.when(main != "", main).when(body != "", body).otherwise(kept)
    return normalize_text(decode_entities(F.regexp_replace(F.regexp_replace(part, "(?s)<!--.*?-->", ""), "<[^>]*>", " ")))


def pairs_of(pages: DataFrame, *strategies: int, **how) -> DataFrame:
    """Rows ``page_id, label, value, strategy, ord`` of these strategies, by one pass over the tags of each page."""
    rows = mk.page_pairs(pages, strategies, **how)
    name = F.initcap(F.replace(F.element_at(F.split("label", ":"), -1), F.lit("_"), F.lit(" ")))
    pair = F.struct(F.when(F.col("strategy") == mk.META, name).otherwise(F.col("label")).alias("label"), "value")
    if mk.LINKED in strategies:
        found = F.when(F.col("strategy") == mk.LINKED, linked_fields(F.col("value"))).otherwise(F.array(pair))
        rows = rows.select("page_id", "strategy", "ord", F.explode(found).alias("p"))
    else:
        rows = rows.select("page_id", "strategy", "ord", pair.alias("p"))
    return rows.select("page_id", "p.label", "p.value", "strategy", "ord")


def linked_fields(json: Column) -> Column:
    """Scalar fields of an object whose type names a product."""
    product = F.try_parse_json(json).isNotNull() & F.coalesce(F.get_json_object(json, "$.@type").contains("Product"), F.lit(False))
    fields = F.map_entries(F.from_json(F.when(product, json), "map<string,variant>"))
    scalar = lambda e: ~e["key"].isin("@context", "@type") & ~F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)")
    pairs = F.transform(F.filter(fields, scalar), lambda e: F.struct(F.initcap(e["key"]).alias("label"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def html_table_pairs(pages: DataFrame) -> DataFrame:
    """Table rows of two cells; cells of inner tables count for outer rows, too."""
    return pairs_of(pages, mk.TABLES)


def html_definition_pairs(pages: DataFrame) -> DataFrame:
    """Terms and descriptions of definition lists, paired as far as the shorter goes."""
    return pairs_of(pages, mk.TERMS)


def text_label_pairs(pages: DataFrame) -> DataFrame:
    """Labelled values in the text of paragraphs, list items, divisions and spans, inner blocks after outer ones.

    A label stands before a colon, its value goes up to a colon or line end; links are no labels.
    """
    return pairs_of(pages, mk.LABELS)


def meta_product_pairs(pages: DataFrame) -> DataFrame:
    """Meta tags with a product property."""
    return pairs_of(pages, mk.META)


def jsonld_product_pairs(pages: DataFrame) -> DataFrame:
    """Scalar fields of linked-data objects whose type names a product."""
    return pairs_of(pages, mk.LINKED)


def all_pairs(pages: DataFrame, **how) -> DataFrame:
    """Rows of all five strategies."""
    return pairs_of(pages, *mk.STRATEGIES, **how)


def fallback_extraction(pages: DataFrame, **how) -> DataFrame:
    """One value for each label of a page; the later strategy and then the later place wins."""
    best = all_pairs(pages, **how).groupBy("page_id", "label").agg(F.max(F.struct("strategy", "ord", "value")).alias("b"))
    return best.select("page_id", "label", F.col("b.value").alias("value"), F.col("b.strategy").alias("strategy"))


def too_short() -> Column:
    return F.length(strip(F.coalesce("html", F.lit("")))) < MIN_PAGE_CHARS


def extract_page(pages: DataFrame, store: str | None = None, parse: Callable[[str], mk.Page] = mk.Page) -> DataFrame:
    """Each page with its pairs; pages of less than 100 characters have an error, pages without pairs stay.

    With ``store``, results are kept there by content (``extract_by_content``). A page that ``parse`` fails on has the
    error ``extraction_failed``.
    """
    error = F.when(too_short(), "empty_html")
    marked = pages.select("page_id", error.alias("error"))
    good = pages.where(error.isNull())
    found = extract_by_content(good, store, parse) if store else fallback_extraction(good, mark=True, parse=parse)
    found = found.select("page_id", "label", F.when(F.col("strategy") != mk.FAILED, F.col("value")).alias("value"), F.when((F.col("strategy") == mk.FAILED) & F.col("value").isNotNull(), "extraction_failed").alias("failed"))
    alone = F.count("label").over(Window.partitionBy("page_id")) == 0
    found = found.withColumn("alone", alone).where("label is not null or alone").drop("alone")
    out = marked.join(found, "page_id", "left").withColumn("error", F.coalesce("error", "failed")).drop("failed")
    return out.withColumn("extraction_method", F.when(F.col("error").isNull(), "fallback"))


STORED = "content_key string, label string, value string, strategy int"


def stored(spark: SparkSession, store: str) -> DataFrame:
    """What a store of extraction results holds, each content once; an absent one is empty."""
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def extract_by_content(pages: DataFrame, store: str, parse: Callable[[str], mk.Page] = mk.Page) -> DataFrame:
    """X7 by content: ``page_id, label, value, strategy`` as ``fallback_extraction(mark=True)`` gives them.

    Results are kept in the folder ``store`` under the SHA-256 of the page, whose first 16 digits are its address (S3).
    Only contents that aren't there are parsed, each once however many pages have it, and added; so a rerun parses nothing,
    and an attempt that failed leaves no partial results behind. Pages come in twice if their hash has to be computed; a
    column ``content_key`` saves that. Two runs at once may both add a content: equal rows count once.
    """
    spark = pages.sparkSession
    if "content_key" not in pages.columns:
        pages = pages.withColumn("content_key", F.sha2("html", 256))
    pages = pages.where("html is not null")
    fresh = pages.select("content_key", "html").join(stored(spark, store).select("content_key").distinct(), "content_key", "left_anti")
    fresh = fresh.groupBy("content_key").agg(F.first("html").alias("html")).withColumnRenamed("content_key", "page_id")
    fallback_extraction(fresh, mark=True, parse=parse).withColumnRenamed("page_id", "content_key").select("content_key", "label", "value", "strategy").write.mode("append").parquet(store)
    return pages.select("page_id", "content_key").join(stored(spark, store).distinct(), "content_key").drop("content_key")


def discover_attributes(pages: DataFrame) -> DataFrame:
    """Labels in pages (tables, definition lists, text) and the pages of each."""
    rows = pairs_of(pages, mk.TABLES, mk.TERMS, mk.LABELS)
    return rows.groupBy("label").agg(F.countDistinct("page_id").alias("n_pages"))


def extract_named(pages: DataFrame, labels: DataFrame, max_labels: int = 100_000) -> DataFrame:
    """The longest value of each wanted label of a page; pages without any get all pairs.

    Labels are broadcast up to ``max_labels``; more are joined by key.
    """
    wanted = labels.select("label").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= max_labels else dealt(wanted)
    w = Window.partitionBy("page_id", "label").orderBy(F.desc(F.length("value")), "strategy", "ord")
    found = all_pairs(pages).where("value <> ''").join(wanted, "label", "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
    found = found.select("page_id", "label", "value", F.lit("named").alias("method"))
    rest = pages.join(found.select("page_id").distinct(), "page_id", "left_anti")
    return found.unionByName(fallback_extraction(rest).select("page_id", "label", "value", F.lit("fallback").alias("method")))


def parse_key_value_text(sources: DataFrame) -> DataFrame:
    """X11: keys and values of lines with a colon, long; the last line of a key wins."""
    lines = sources.select("source_id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.instr("line", ":") > 0)
    key = F.lower(strip(F.substring_index("line", ":", 1)))
    value = strip(F.expr("substring(line, instr(line, ':') + 1)"))
    last = lines.select("source_id", "pos", key.alias("key"), value.alias("value")).groupBy("source_id", "key").agg(F.max_by("value", "pos").alias("value"))
    return last


def product_of_text(pairs: DataFrame) -> DataFrame:
    """X11: ``sku`` (or ``mpn``) and ``title`` (``product_name`` or ``brand``) of each source."""
    of = lambda k: F.nullif(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(""))
    return pairs.groupBy("source_id").agg(F.coalesce(of("sku"), of("mpn")).alias("sku"), F.coalesce(of("product_name"), of("brand")).alias("title"), of("brand").alias("brand"))


def parse_model_json(responses: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """JSON of a response without its code fence; what can't be parsed is an error row."""
    text = strip(F.col(column))
    for fence in ("```json", "```"):
        text = F.when(F.startswith(text, F.lit(fence)), strip(F.substring(text, len(fence) + 1, F.length(text) - len(fence) - 3))).otherwise(text)
    out = responses.withColumn("parsed", F.from_json(text, schema, {"mode": "PERMISSIVE"})).withColumn("_ok", F.try_parse_json(text).isNotNull())
    return out.withColumn("error", F.when(~F.col("_ok"), "invalid_json")).drop("_ok")


def truncate_and_guard_text(documents: DataFrame, most: int = DOCUMENT_CHARS) -> DataFrame:
    """The first 12,000 characters of a document; a blank one is an error."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return documents.withColumn("error", F.when(blank, "empty_pdf")).withColumn("text", F.when(~blank, F.substring("text", 1, most)))
