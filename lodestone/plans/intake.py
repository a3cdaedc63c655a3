"""Registered queries on sources and pages: files (S), selection (K), extraction (X), compositions (G), hooks (U), stream (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.fixtures import frame, with_views
from lodestone.functions import text as tx
from lodestone.operators import extract as ex
from lodestone.operators import golden as gd
from lodestone.operators import model_hook as mh
from lodestone.plans import aggregate as ag
from lodestone.plans import values
from lodestone.sources import files, selection
from lodestone.storage import shared_path
from lodestone.streaming.ingest import ingest_stream

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return keep


@query("s1_read_catalog_file", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def s1(spark, d):
    path = shared_path(spark, "customer-csv")
    frame(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(path)
    rows = files.read_catalog_file(spark, path)
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))


def intake(spark, d):
    return files.normalize_intake(frame(spark, d, "fx_intake").withColumnsRenamed({"sku": "SKU ", "product_title": "Product Title"}))


_INTAKE = """intake AS (SELECT row_no, batch_id, coalesce(nullif(trim(sku), ''), nullif(trim(mpn), '')) AS mpn, nullif(trim(product_title), '') AS title FROM fx_intake
  WHERE coalesce(nullif(trim(sku), ''), nullif(trim(mpn), ''), nullif(trim(product_title), '')) IS NOT NULL)"""


@query("s2_normalize_intake", f"WITH {_INTAKE} SELECT row_no, batch_id, mpn, title FROM intake")
def s2(spark, d):
    return intake(spark, d).select("row_no", "batch_id", "mpn", "title")


@query("s3_content_address", "SELECT page_id, substr(sha256(html), 1, 16) AS content_hash, CASE WHEN contains(lower(url), 'pdf') THEN 'pdf' ELSE 'html' END AS kind FROM pages")
def s3(spark, d):
    return files.content_address(frame(spark, d, "pages"), content_type=F.col("url")).select("page_id", "content_hash", "kind")


@query("s4_register_source", "SELECT source_id, source_type, source_url, project_id, 'processing' AS status, CAST(length(content) AS INT) AS raw_length FROM fx_kv_sources")
def s4(spark, d):
    out = files.register_source(frame(spark, d, "fx_kv_sources"))
    return out.select("source_id", "source_type", "source_url", "project_id", "status", "metadata.raw_length")


@query("s5_export_catalog_csv", "SELECT product_code, concat_ws(',', product_code, coalesce(brand_name, ''), product_name, CAST(completeness_score AS VARCHAR) || '%') AS line FROM fx_products WHERE published_at IS NOT NULL")
def s5(spark, d):
    return files.export_lines(frame(spark, d, "fx_products"))


@query("s6_batch_result_sheet", """SELECT p_partkey AS row_no, 'P-' || CAST(p_partkey AS VARCHAR) AS input_sku, p_name AS input_title, p_partkey % 2 = 0 AS ready_for_publish, CAST(0.7 AS DOUBLE) AS confidence,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS sources_count, CASE WHEN p_partkey % 4 = 0 THEN 'No sources found' ELSE 'https://a/' || CAST(p_partkey AS VARCHAR) || chr(10) || 'https://b/' || CAST(p_partkey AS VARCHAR) END AS source_urls,
  max(value) FILTER (WHERE attribute = 'size') AS size, max(value) FILTER (WHERE attribute = 'type') AS type, max(value) FILTER (WHERE attribute = 'list_price') AS list_price
  FROM part JOIN fx_product_attributes ON product_code = 'P-' || CAST(p_partkey AS VARCHAR) GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def s6(spark, d):
    part = frame(spark, d, "part")
    code = F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))
    rows = part.select(F.col("p_partkey").alias("row_no"), code.alias("mpn"), F.col("p_name").alias("title"), (F.col("p_partkey") % 2 == 0).alias("ready"), F.lit(0.7).alias("confidence"))
    attributes = frame(spark, d, "fx_product_attributes").join(rows.select("row_no", F.col("mpn").alias("product_code")), "product_code")
    url = lambda host: F.concat(F.lit(f"https://{host}/"), F.col("p_partkey").cast("string"))
    sources = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("row_no"), F.posexplode(F.array(url("a"), url("b"))).alias("source_pos", "url"))
    return files.batch_result_sheet(rows, attributes, sources, ["size", "type", "list_price"])


@query("s7_batch_status", """SELECT batch_id, CASE WHEN k = 0 THEN 'queued' WHEN o = 0 THEN 'completed' ELSE 'processing' END AS status,
  CASE WHEN k > 0 AND o = 0 THEN '100%' ELSE CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) END AS progress
  FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE done AND NOT skipped) AS k, count(*) FILTER (WHERE NOT done AND NOT skipped) AS o
    FROM (SELECT batch_id, row_no % 4 <> 0 OR batch_id % 2 = 0 AS done, sku = '' AND mpn IS NULL AND product_title IS NULL AS skipped FROM fx_intake) x GROUP BY 1) y""")
def s7(spark, d):
    done = (F.col("row_no") % 4 != 0) | (F.col("batch_id") % 2 == 0)
    skipped = (F.col("sku") == "") & F.col("mpn").isNull() & F.col("product_title").isNull()
    return files.batch_status(frame(spark, d, "fx_intake").select("batch_id", done.alias("done"), skipped.alias("skipped")))


@query("s8_snapshot_read_write", "SELECT product_code, product_name, completeness_score FROM fx_products UNION ALL SELECT product_code, product_name, completeness_score FROM fx_products WHERE product_id % 10 = 0")
def s8(spark, d):
    path = shared_path(spark, "products")
    rows = frame(spark, d, "fx_products")
    wanted = ["product_code", "product_name", "completeness_score"]
    files.write_snapshot(rows.select(*wanted), path)
    files.write_snapshot(rows.where("product_id % 10 = 0").select(*wanted), path, "append")
    return files.read_snapshot(spark, path)


@query("k1_build_queries", f"WITH {_INTAKE} SELECT row_no, 0 AS query_pos, coalesce(mpn, '') || ' datasheet pdf' AS query FROM intake")
def k1(spark, d):
    return selection.build_queries(intake(spark, d))


@query("k2_rank_results", "SELECT product_key, result_rank, url, fetched FROM fx_search_results WHERE result_rank <= 5")
def k2(spark, d):
    return selection.rank_results(frame(spark, d, "fx_search_results"))


_K3 = """firsts AS (SELECT product_key, url, result_rank, fetched FROM (SELECT *, row_number() OVER (PARTITION BY product_key, url ORDER BY result_rank) AS r FROM fx_search_results) x WHERE r = 1),
 chosen AS (SELECT product_key, url, result_rank, source_pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_key ORDER BY result_rank) AS INT) AS source_pos FROM firsts WHERE fetched) y WHERE source_pos <= 3)"""


@query("k3_select_sources", f"WITH {_K3} SELECT product_key, url, result_rank, source_pos FROM chosen")
def k3(spark, d):
    return selection.select_sources(frame(spark, d, "fx_search_results"))


@query("k4_sources_used", f"WITH {_K3} SELECT product_key, count(*) AS sources_used FROM chosen GROUP BY 1")
def k4(spark, d):
    return selection.sources_used(selection.select_sources(frame(spark, d, "fx_search_results")))


def spec(spark, d):
    return frame(spark, d, "fx_spec_pages")


def without_tags(x: str) -> str:
    for t in ex.DROPPED_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{t}\b.*?</{t}\s*>', '', 'g')"
    return x


_MAIN = rf"regexp_extract(kept, '(?is)<main\b[^>]*>(.*?)</main\s*>', 1)"
_BODY = rf"regexp_extract(kept, '(?is)<body\b[^>]*>(.*?)</body\s*>', 1)"
_PLAIN = "regexp_replace(regexp_replace(part, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')"


def decoded(x: str) -> str:
    for entity, sign in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


@query("x1_html_main_text", f"""WITH k AS (SELECT page_id, {without_tags('html')} AS kept FROM pages), p AS (SELECT page_id, CASE WHEN {_MAIN} <> '' THEN {_MAIN} WHEN {_BODY} <> '' THEN {_BODY} ELSE kept END AS part FROM k)
  SELECT page_id, md5({values.norm(decoded(_PLAIN))}) AS text_md5 FROM p""")
def x1(spark, d):
    return frame(spark, d, "pages").select("page_id", F.md5(ex.html_main_text(F.col("html"))).alias("text_md5"))


_X2 = "SELECT page_id, rtrim(regexp_extract(html, '<th>([^<]*)</th><td>([^<]*)</td>', 1), ':') AS label, trim(regexp_extract(html, '<th>([^<]*)</th><td>([^<]*)</td>', 2)) AS value, 1 AS strategy FROM fx_spec_pages"
_X3 = "SELECT page_id, rtrim(regexp_extract(html, '<dl><dt>([^<]*)</dt><dd>([^<]*)</dd>', 1), ':') AS label, regexp_extract(html, '<dl><dt>([^<]*)</dt><dd>([^<]*)</dd>', 2) AS value, 2 AS strategy FROM fx_spec_pages"
_X4 = "SELECT page_id, regexp_extract(html, '<li>([^:<]*): ([^<]*)</li>', 1) AS label, regexp_extract(html, '<li>([^:<]*): ([^<]*)</li>', 2) AS value, 3 AS strategy FROM fx_spec_pages"
_X5 = "SELECT page_id, 'Retail Price' AS label, regexp_extract(html, 'property=\"product:retail_price\" content=\"([^\"]*)\"', 1) AS value, 4 AS strategy FROM fx_spec_pages"
_X6 = """SELECT page_id, 'Name' AS label, regexp_extract(html, '"name":"([^"]*)"', 1) AS value, 5 AS strategy FROM fx_spec_pages UNION ALL SELECT page_id, 'Sku', regexp_extract(html, '"sku":"([^"]*)"', 1), 5 FROM fx_spec_pages"""
_PAIRS = f"{_X2} UNION ALL {_X3} UNION ALL {_X4} UNION ALL {_X5} UNION ALL {_X6}"

for _name, _op, _sql in (
    ("x2_html_table_pairs", ex.html_table_pairs, _X2), ("x3_html_definition_pairs", ex.html_definition_pairs, _X3), ("x4_text_label_pairs", ex.text_label_pairs, _X4),
    ("x5_meta_product_pairs", ex.meta_product_pairs, _X5), ("x6_jsonld_product_pairs", ex.jsonld_product_pairs, _X6), ("x7_fallback_extraction", ex.fallback_extraction, _PAIRS),
):
    query(_name, _sql)(lambda spark, d, op=_op: op(spec(spark, d)).select("page_id", "label", "value", "strategy"))


def every_page(spark, d):
    """All pages whole, under negative ids, and the spec pages."""
    pages = frame(spark, d, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    return spec(spark, d).select("page_id", "html").unionByName(pages)


#: No given page has a pair: a page of another kind would show as a difference.
@query("x8_extract_page", f"SELECT page_id, NULL AS error, label, value FROM ({_PAIRS}) x UNION ALL SELECT -1 - page_id, CASE WHEN length(trim(html)) < 100 THEN 'empty_html' END, NULL, NULL FROM pages")
def x8(spark, d):
    return ex.extract_page(every_page(spark, d)).select("page_id", "error", "label", "value")


_NESTED = """SELECT page_id, label, value, 3 AS strategy FROM (SELECT p_partkey AS page_id, unnest([
   {'label': 'Weight', 'value': CAST(p_size AS VARCHAR) || ' kg'}, {'label': 'Colour', 'value': 'red (RAL 3000)'}, {'label': 'Material Type', 'value': p_type || '.Made in Country'},
   {'label': 'Made in Country', 'value': p_brand || '.'}, {'label': 'Size', 'value': CAST(p_size AS VARCHAR) || ' cmDepth' || CAST(p_size + 1 AS VARCHAR) || 'x'}], recursive := true) FROM part) x"""


@query("x4_nested_blocks", f"{_NESTED} UNION ALL SELECT p_partkey, 'Weight', CAST(p_size AS VARCHAR) || ' kgColour', 3 FROM part")
def x4_nested(spark, d):
    return ex.text_label_pairs(frame(spark, d, "fx_nested_pages")).select("page_id", "label", "value", "strategy")


@query("x7_nested_markup", f"{_NESTED} UNION ALL SELECT p_partkey, 'Depth', CAST(p_size + 1 AS VARCHAR), 1 FROM part")
def x7_nested(spark, d):
    return ex.fallback_extraction(frame(spark, d, "fx_nested_pages")).select("page_id", "label", "value", "strategy")


@query("x8_extract_by_content", f"SELECT page_id + k * 100000000 AS page_id, label, value, strategy FROM ({_NESTED} UNION ALL SELECT p_partkey, 'Depth', CAST(p_size + 1 AS VARCHAR), 1 FROM part) x, (VALUES (0), (1), (2)) AS v(k)")
def x8_by_content(spark, d):
    """Every page under three ids, in two runs over one store: the second parses only what the first has not seen."""
    pages, store = frame(spark, d, "fx_nested_pages"), shared_path(spark, "extracted")
    ex.extract_by_content(pages.where("page_id % 3 > 0"), store)
    copies = pages.select(F.explode(F.array(*[F.col("page_id") + k * 100000000 for k in range(3)])).alias("page_id"), "html")
    return ex.extract_by_content(copies, store).where("label is not null")


@query("x9_discover_attributes", f"SELECT label, count(DISTINCT page_id) AS n_pages FROM ({_X2} UNION ALL {_X3} UNION ALL {_X4}) x GROUP BY 1")
def x9(spark, d):
    return ex.discover_attributes(spec(spark, d))


@query("x10_extract_named", f"SELECT page_id, label, value, 'named' AS method FROM ({_PAIRS}) x WHERE label IN ('Size', 'Brand', 'Sku')")
def x10(spark, d):
    return ex.extract_named(spec(spark, d), spark.createDataFrame([("Size",), ("Brand",), ("Sku",)], "label string"))


def wanted_labels(spark):
    return spark.createDataFrame([("Size",), ("Brand",), ("Sku",)], "label string")


#: X2 to X10 over every page. SQL of DuckDB can't express their patterns on free markup; tests hold them against a parser.
for _name, _op in (
    ("x2_html_table_pairs_every_page", ex.html_table_pairs), ("x3_html_definition_pairs_every_page", ex.html_definition_pairs), ("x4_text_label_pairs_every_page", ex.text_label_pairs),
    ("x5_meta_product_pairs_every_page", ex.meta_product_pairs), ("x6_jsonld_product_pairs_every_page", ex.jsonld_product_pairs), ("x7_fallback_extraction_every_page", ex.fallback_extraction),
    ("x8_extract_page_every_page", ex.extract_page), ("x9_discover_attributes_every_page", ex.discover_attributes),
):
    query(_name, None)(lambda spark, d, op=_op: op(every_page(spark, d)))
query("x10_extract_named_every_page", None)(lambda spark, d: ex.extract_named(every_page(spark, d), wanted_labels(spark)))


_KV = """kv AS (SELECT source_id, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, instr(line, ':') + 1)) AS value, n
  FROM (SELECT source_id, parts[n] AS line, n FROM (SELECT source_id, string_split(content, chr(10)) AS parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM fx_kv_sources) a) b WHERE instr(line, ':') > 0)"""


@query("x11_parse_key_value_text", f"WITH {_KV} SELECT source_id, key, arg_max(value, n) AS value FROM kv GROUP BY 1, 2")
def x11(spark, d):
    return ex.parse_key_value_text(frame(spark, d, "fx_kv_sources"))


@query("x12_parse_model_json", "SELECT id, CASE WHEN id % 4 <> 3 THEN regexp_extract(content, '\"brand\":\"([^\"]*)\"', 1) END AS brand, CASE WHEN id % 4 = 3 THEN 'invalid_json' END AS error FROM fx_model_responses")
def x12(spark, d):
    return ex.parse_model_json(frame(spark, d, "fx_model_responses"), "brand string").select("id", "parsed.brand", "error")


@query("x13_truncate_and_guard_text", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_pdf' END AS error, length(substr(text, 1, 12000)) AS n_chars, md5(substr(text, 1, 12000)) AS text_md5 FROM documents")
def x13(spark, d):
    out = ex.truncate_and_guard_text(frame(spark, d, "documents"))
    return out.select("doc_id", "error", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def spec_results(spark, d):
    """Search results that lead each part to its page, after a link that could not be fetched."""
    pages = spec(spark, d).select(F.col("page_id").alias("product_key"), "url")
    return pages.withColumn("result_rank", F.lit(2).cast("long")).withColumn("fetched", F.lit(True)).unionByName(
        pages.select("product_key", F.concat("url", F.lit("/gone")).alias("url"), F.lit(1).cast("long").alias("result_rank"), F.lit(False).alias("fetched")))


def aggregated(spark, d):
    ids = frame(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("mpn"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("title"))
    results = spec_results(spark, d).where("product_key % 7 <> 0")
    return ag.aggregate_products(ids, results, spec(spark, d), frame(spark, d, "fx_synonyms"), values.rules(spark).where("active"))


_RECORD = """SELECT p_partkey AS product_key, 'P-' || CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_partkey % 6 = 0 THEN 'UNKNOWN' ELSE split_part(p_name, ' ', 1) END AS brand, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 6 END AS BIGINT) AS n_attributes,
  p_partkey % 7 <> 0 AND p_partkey % 6 <> 0 AS ready_for_publish, CASE WHEN p_partkey % 7 <> 0 THEN CAST(0.7 AS DOUBLE) END AS confidence, CASE WHEN p_partkey % 7 = 0 THEN 'no_standardized_data' END AS error,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS sources_used, CASE WHEN p_partkey % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 'no_sources' END AS reason FROM part"""


@query("g5_aggregate_product", _RECORD)
def g5(spark, d):
    return aggregated(spark, d)[0]


_SOURCES = """SELECT p_partkey AS product_key, unnest([{'attribute': 'size', 'standard_value': CAST(p_size + 20 AS VARCHAR) || ' cm'},
   {'attribute': 'surface', 'standard_value': 'polished'}, {'attribute': 'shelf', 'standard_value': p_brand}], recursive := true) FROM part"""


@query("g5_conflicting_sources", f"SELECT product_key, attribute, standard_value FROM ({_SOURCES}) x")
def g5_sources(spark, d):
    """Three sources for each product: two agree nearly against the first on a number, the third differs in a text and adds one."""
    pages = frame(spark, d, "fx_source_pages")
    ids = pages.select("product_key").distinct().select("product_key", F.col("product_key").cast("string").alias("mpn"), F.lit("Part").alias("title"))
    results = pages.select("product_key", F.col("source_no").cast("long").alias("result_rank"), "url", F.lit(True).alias("fetched"))
    done = ag.aggregate_products(ids, results, pages, spark.createDataFrame([], "label string, canonical string, confidence double"), values.rules(spark).where("active"))[1]
    return done.select("product_key", "attribute", F.coalesce("standard_value", F.col("standard_number").cast("string")).alias("standard_value"))


@query("g6_batch_aggregate", f"""SELECT product_key AS row_no, sku AS input_sku, ready_for_publish, confidence, sources_count, source_urls, CASE WHEN ok THEN brand END AS brand, CASE WHEN ok THEN material END AS material_type FROM (
  SELECT r.product_key, r.sku, r.ready_for_publish, r.confidence, r.sources_used AS sources_count, r.status = 'success' AS ok, p_brand AS brand, p_type AS material,
  CASE WHEN r.status = 'success' THEN 'https://shop.example.org/p/' || CAST(p_partkey AS VARCHAR) ELSE 'No sources found' END AS source_urls FROM ({_RECORD}) r JOIN part ON p_partkey = r.product_key) x""")
def g6(spark, d):
    records, done = aggregated(spark, d)
    rows = records.select(F.col("product_key").alias("row_no"), F.col("sku").alias("mpn"), F.col("brand").alias("title"), F.col("ready_for_publish").alias("ready"), "confidence")
    chosen = selection.select_sources(spec_results(spark, d).where("product_key % 7 <> 0")).select(F.col("product_key").alias("row_no"), "source_pos", "url")
    attributes = done.select(F.col("product_key").alias("row_no"), "attribute", F.coalesce("standard_value", F.col("standard_number").cast("string")).alias("value"))
    return files.batch_result_sheet(rows, attributes, chosen, ["brand", "material_type"]).drop("input_title")


_PRODUCTS = """SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS product_code, p_type AS product_name, p_type AS brand_name, 'completed' AS enrichment_status, 30 AS completeness_score FROM part"""


def web(spark, d):
    """Search results, pages, synonyms and rules of all parts."""
    results = spec_results(spark, d).withColumn("product_key", F.concat(F.lit("P-"), F.col("product_key").cast("string")))
    return ag.Web(results, spec(spark, d), frame(spark, d, "fx_synonyms"), values.rules(spark).where("active"))


@query("g12_ingest_sources", _PRODUCTS)
def g12(spark, d):
    return ag.ingest_sources(frame(spark, d, "fx_kv_sources"), ag.Catalog.empty(spark), web(spark, d)).products


@query("g12_ingest_effects", """SELECT 'audit' AS effect, sources_used AS detail, count(*) AS n FROM (SELECT coalesce(nullif(source_url, ''), 'Manual Input') AS sources_used FROM fx_kv_sources) a GROUP BY 1, 2
  UNION ALL SELECT 'priority', CASE WHEN source_type = 'pdf' THEN '0.9' ELSE '0.7' END, count(*) FROM fx_kv_sources GROUP BY 1, 2 UNION ALL SELECT 'status', 'completed', count(*) FROM fx_kv_sources GROUP BY 1, 2""")
def g12e(spark, d):
    after = ag.ingest_sources(frame(spark, d, "fx_kv_sources"), ag.Catalog.empty(spark), web(spark, d))
    parts = after.audit.select(F.lit("audit").alias("effect"), F.col("sources_used").alias("detail"))
    parts = parts.unionByName(after.priorities.select(F.lit("priority").alias("effect"), F.col("reliability_score").cast("string").alias("detail")))
    parts = parts.unionByName(after.sources.select(F.lit("status").alias("effect"), F.col("status").alias("detail")))
    return parts.groupBy("effect", "detail").agg(F.count("*").alias("n"))


@query("u1_safe_apply", "SELECT id, id % 4 = 2 AS ok, CASE WHEN id % 4 <> 2 THEN 'llm_exception' END AS error FROM fx_model_responses")
def u1(spark, d):
    import json

    return mh.safe_apply(frame(spark, d, "fx_model_responses"), "id", "content", json.loads).select("id", "ok", "error")


@query("u2_similarity_ratio", None)
def u2(spark, d):
    pairs = values.d2(spark, d)
    return pairs.select("attribute", "a", "b", F.round(mh.similarity_ratio(F.col("b"), F.col("a")), 6).alias("ratio"))


@query("t1_ingest_stream", _PRODUCTS)
def t1(spark, d):
    submissions = shared_path(spark, "submissions")
    frame(spark, d, "fx_kv_sources").repartition(3, "source_id").write.parquet(submissions)
    return ingest_stream(spark, submissions, shared_path(spark, "ingest"), web(spark, d))
