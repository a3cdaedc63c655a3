"""Catalog views derived from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "lineitem", "orders", "events", "customer", "supplier", "pages", "documents", "region", "nation")

VIEWS = {
    "fx_observations": r"""
SELECT l_partkey AS product_key, attribute, CAST(pos AS BIGINT) AS pos, value, source FROM (
 SELECT l_partkey, pos, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
  CASE pos % 4 WHEN 0 THEN 'width' WHEN 1 THEN 'finish' WHEN 2 THEN 'grade' ELSE 'extras' END AS attribute,
  CASE pos % 4
   WHEN 0 THEN CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'N/A'
     ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE l_linenumber % 3 WHEN 0 THEN ' inch' WHEN 1 THEN '"' ELSE '  IN ' END) END
   WHEN 1 THEN CASE l_linenumber % 5 WHEN 0 THEN '  Deep   Blue ' WHEN 1 THEN 'deep blue' WHEN 2 THEN 'Black' WHEN 3 THEN 'Deep Bluee' ELSE 'TBD' END
   WHEN 2 THEN CASE l_linenumber % 4 WHEN 0 THEN 'Sold as Grade B' WHEN 1 THEN 'Grade A on arrival' WHEN 2 THEN 'grade c' ELSE 'None' END
   ELSE CASE l_linenumber % 4 WHEN 0 THEN 'Bluetooth' WHEN 1 THEN 'GPS' WHEN 2 THEN ' bluetooth ' ELSE 'Wi-Fi' END
  END AS value,
  CASE l_suppkey % 8 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'official_site' WHEN 2 THEN 'truth_engine' WHEN 3 THEN 'datasheet'
   WHEN 4 THEN 'web' WHEN 5 THEN 'vendor' WHEN 6 THEN 'inference' ELSE 'marketplace' END AS source
 FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS pos FROM lineitem) a) b
""",
    "fx_products": r"""
SELECT concat('P-', CAST(p_partkey AS STRING)) AS product_code, p_partkey AS product_id, p_name AS product_name,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand_name, p_type AS category_1,
 CASE WHEN p_partkey % 5 = 0 THEN 'pending' ELSE 'completed' END AS enrichment_status,
 CASE WHEN p_size * 2 > 100 THEN 100 ELSE p_size * 2 END AS completeness_score,
 CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS published_at
FROM part
""",
    "fx_product_attributes": r"""
SELECT concat('P-', CAST(p_partkey AS STRING)) AS product_code, 'size' AS attribute, CAST(p_size AS STRING) AS value FROM part
UNION ALL SELECT concat('P-', CAST(p_partkey AS STRING)), 'type', CASE WHEN p_partkey % 7 = 0 THEN 'N/A' ELSE p_type END FROM part
UNION ALL SELECT concat('P-', CAST(p_partkey AS STRING)), 'list_price',
 CASE WHEN p_partkey % 13 = 0 THEN 'call us' WHEN p_partkey % 17 = 0 THEN '$0' ELSE concat('$1,', CAST(100 + p_size AS STRING)) END FROM part
""",
    "fx_raw_extractions": r"""
SELECT l_suppkey AS source_id, concat('P-', CAST(l_partkey AS STRING)) AS sku, l_orderkey, l_linenumber,
 1.0 - l_discount AS confidence, CAST(p_size + l_linenumber % 2 AS STRING) AS attr_size, p_type AS attr_type,
 CASE WHEN l_linenumber = 1 THEN l_returnflag END AS attr_flag
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "fx_spec_pages": r"""
SELECT p_partkey AS page_id, concat('https://shop.example.org/p/', CAST(p_partkey AS STRING)) AS url,
 concat('<!DOCTYPE html><html><head><meta charset="utf-8"><meta property="product:retail_price" content="', CAST(p_size * 10 AS STRING),
 '"><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"', p_name, '","sku":"P-', CAST(p_partkey AS STRING),
 '","offers":{"x":1}}</script></head><body><nav>Menu: home</nav><main><table><tr><th>Size:</th><td>', CAST(p_size AS STRING),
 ' cm</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table><dl><dt>Brand:</dt><dd>', p_brand, '</dd><dt>Orphan</dt></dl><ul><li>Material Type: ', p_type,
 '</li></ul></main><footer>end</footer></body></html>') AS html
FROM part
""",
    "fx_nested_pages": r"""
SELECT p_partkey AS page_id, concat('<html><head><title>Part: nested</title></head><body><div class="spec"><div><p>Weight: ', CAST(p_size AS STRING),
 ' kg</p><p>Colour: red (RAL 3000)</p></div><ul><li>Material Type: ', p_type, '.<li>Made in Country: ', p_brand, '.</ul><table><tr><th>Size:</th><td>', CAST(p_size AS STRING),
 ' cm</td></tr><tr><td><table><tr><td>Depth</td><td>', CAST(p_size + 1 AS STRING), '</td></tr></table></td><td>x</td></tr></table></div></body></html>') AS html
FROM part
""",
    "fx_source_pages": r"""
SELECT p_partkey * 4 + k AS page_id, p_partkey AS product_key, k AS source_no, concat('https://s', CAST(k AS STRING), '.example.org/p/', CAST(p_partkey AS STRING)) AS url,
 concat('<html><body><h1>A part as this source describes it, in its own words</h1><div class="specs"><table><tr><td>Size</td><td>', CAST(p_size + CASE WHEN k = 1 THEN 0 ELSE 20 END AS STRING),
 CASE WHEN k = 3 THEN '.5' ELSE '' END, ' cm</td></tr></table><p>*</p><ul><li>Surface: ', CASE k WHEN 1 THEN 'polished' WHEN 2 THEN 'Polished ' ELSE 'brushed' END, '</li>',
 CASE WHEN k = 3 THEN concat('<li>Shelf: ', p_brand, '</li>') ELSE '' END, '</ul></div></body></html>') AS html
FROM part, (VALUES (1), (2), (3)) AS v(k)
""",
    "fx_labelled_values": r"""
SELECT label, value FROM (
 SELECT 'Size' AS label, concat(CAST(p_size AS STRING), ' cm') AS value FROM part
 UNION ALL SELECT 'Item Size', concat(' ', CAST(p_size AS STRING), '  CM') FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT 'Dimension', concat(CAST(p_size + CASE WHEN p_size > 45 THEN 100 ELSE 0 END AS STRING), ' cm') FROM part
 UNION ALL SELECT 'Weight', concat(CAST(p_size AS STRING), ' kg') FROM part UNION ALL SELECT 'Pieces', CAST(p_size AS STRING) FROM part
 UNION ALL SELECT 'Brand', p_brand FROM part UNION ALL SELECT 'Maker', upper(p_brand) FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 'Sold', CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END FROM part UNION ALL SELECT 'New', CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'no' END FROM part
 UNION ALL SELECT 'Name', concat(p_name, ' ', CAST(p_partkey AS STRING)) FROM part) x
""",
    "fx_kv_sources": r"""
SELECT p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN 'pdf' ELSE 'html' END AS source_type,
 CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('https://s.example.org/', CAST(p_partkey AS STRING)) END AS source_url,
 CASE WHEN p_partkey % 2 = 0 THEN 'proj-a' END AS project_id,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * p_size AS uploaded_at,
 concat(' SKU : P-', CAST(p_partkey AS STRING), chr(10), 'brand: ', p_brand, chr(10), 'no separator here', chr(10), 'Note: a:b', chr(10), 'brand: ', p_type) AS content
FROM part
""",
    "fx_search_results": r"""
SELECT user_id AS product_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS result_rank,
 concat('https://r.example.org/', event_type, '/', CAST(event_id % 4 AS STRING)) AS url, event_type <> 'error' AS fetched FROM events
""",
    "fx_review_items": r"""
SELECT o_orderkey AS queue_id, concat('P-', CAST(o_custkey % 100 AS STRING)) AS product_code,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'size' WHEN '2-HIGH' THEN 'type' ELSE 'list_price' END AS attribute,
 CAST(o_orderkey % 50 AS STRING) AS proposed_value, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.7 END AS DOUBLE) AS confidence,
 CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status FROM orders
""",
    "fx_audit": r"""
SELECT event_id AS id, concat('P-', CAST(user_id AS STRING)) AS product_id, event_type AS stage, value AS selected_value, ts AS logged_at FROM events
""",
    "fx_projects": r"""
SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'archived' ELSE 'draft' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * c_nationkey AS created_at FROM customer
""",
    "fx_intake": r"""
SELECT c_custkey AS row_no, c_nationkey AS batch_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('P-', CAST(c_custkey AS STRING)) END AS sku,
 CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN concat('M-', CAST(c_custkey AS STRING)) END AS mpn,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(c_mktsegment, ' item ', CAST(c_custkey AS STRING)) END AS product_title FROM customer
""",
    "fx_enrichments": r"""
SELECT p_partkey AS product_id, concat(p_brand, ' ', p_name) AS seo_title, p_size % 7 AS n_bullets, CAST(p_size AS DOUBLE) / 50 AS confidence FROM part WHERE p_partkey % 2 = 0
""",
    "fx_model_responses": r"""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('```json', chr(10), '{"brand":"', p_brand, '"}', chr(10), '```')
 WHEN 1 THEN concat('```', '{"brand":"', p_brand, '"}', '```') WHEN 2 THEN concat('{"brand":"', p_brand, '"}') ELSE 'not json' END AS content FROM part
""",
    "fx_priorities": r"""
SELECT CAST(s_nationkey AS STRING) AS project_id, s_suppkey AS source_id,
 CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS priority_rank, s_acctbal / 10000 AS reliability_score FROM supplier
""",
    "fx_targets": r"""
SELECT CAST(s_nationkey AS STRING) AS project_id, s_name AS target_name, CASE WHEN s_suppkey % 2 = 0 THEN 'csv' ELSE 'shop' END AS target_type,
 s_suppkey % 3 <> 0 AS active FROM supplier
""",
    "fx_weights": r"""
SELECT * FROM (VALUES ('manufacturer', 0.95), ('official_site', 0.9), ('truth_engine', 0.88), ('datasheet', 0.9), ('web', 0.7),
 ('vendor', 0.65), ('inference', 0.4)) AS w(source, confidence)
""",
    "fx_synonyms": r"""
SELECT * FROM (VALUES ('Size', 'width', 0.98), ('Product Type', 'part_type', 0.9), ('Retail Price', 'list_price', 0.96), ('Sku', 'stock_number', 0.93),
 ('Flag', 'stock_flag', 0.9)) AS s(label, canonical, confidence)
""",
}

#: Views that make whole pages from small rows: a file of a few MB has so many that one task would parse them for long, so
#: the rows are dealt out before.
MADE_PAGES = ("fx_spec_pages", "fx_nested_pages", "fx_source_pages")


def sql_for_spark(sql: str) -> str:
    """Table names after FROM and JOIN as parameters of ``spark.sql``."""
    text = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", lambda m: f"{m[1]} {{{m[2]}}}", text)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = sql_for_spark(VIEWS[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if name in MADE_PAGES:
        used = {t: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *df.columns[:1]) for t, df in used.items()}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names before it."""
    needed = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    rest = sql.strip()
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        return f"WITH {', '.join([*heads, rest])}" if heads else sql
    return f"WITH {', '.join(heads)} {rest}" if heads else sql
