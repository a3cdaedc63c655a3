"""Registered queries on the catalog tables: reads and updates (R), golden records (G), enrichment (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.fixtures import frame, with_views
from lodestone.operators import catalog as ct
from lodestone.operators import enrich as en
from lodestone.operators import golden as gd
from lodestone.operators import metrics as mt
from lodestone.plans import values
from lodestone.sources.keyed import KeyedTable
from lodestone.sources.ranges import RangedTable
from lodestone.storage import shared_path

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return keep


_SOURCE = ["source_id", "source_type", "source_url", "project_id", "uploaded_at"]


@query("r1_list_sources", "SELECT source_id, source_type, source_url, project_id, uploaded_at FROM fx_kv_sources")
def r1(spark, d):
    return ct.newest(frame(spark, d, "fx_kv_sources"), "uploaded_at", "source_id").select(*_SOURCE)


@query("r2_project_priorities", "SELECT project_id, source_id, priority_rank FROM fx_priorities WHERE project_id IN ('3', '7')")
def r2(spark, d):
    p = frame(spark, d, "fx_priorities")
    return ct.project_priorities(p, "3").unionByName(ct.project_priorities(p, "7")).select("project_id", "source_id", "priority_rank")


@query("r3_review_pending", "SELECT queue_id, product_code, attribute, proposed_value, status FROM fx_review_items WHERE status = 'pending'")
def r3(spark, d):
    return ct.review_pending(frame(spark, d, "fx_review_items"), "pending").select("queue_id", "product_code", "attribute", "proposed_value", "status")


def extractions(spark, d):
    """Raw extractions with their labels as a map."""
    raw = frame(spark, d, "fx_raw_extractions")
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("size", "attr_size"), ("type", "attr_type"), ("flag", "attr_flag"))])
    return raw.withColumn("attributes", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))


_LONG = """long AS (SELECT sku, source_id, confidence, 'size' AS label, attr_size AS v FROM fx_raw_extractions UNION ALL SELECT sku, source_id, confidence, 'type', attr_type FROM fx_raw_extractions
  UNION ALL SELECT sku, source_id, confidence, 'flag', attr_flag FROM fx_raw_extractions WHERE attr_flag IS NOT NULL)"""


_R4 = f"""WITH {_LONG}, m AS (SELECT source_id, avg(confidence) AS c FROM fx_raw_extractions GROUP BY 1), n AS (SELECT source_id, count(DISTINCT label) AS n FROM long GROUP BY 1)
  SELECT s_suppkey AS source_id, round(coalesce(c, 0.0), 2) AS avg_confidence, coalesce(n, 0) AS n_attributes, round(least(coalesce(n, 0) / 20.0, 1.0), 2) AS completeness
  FROM supplier LEFT JOIN m ON m.source_id = s_suppkey LEFT JOIN n ON n.source_id = s_suppkey"""


@query("r4_source_metrics", _R4)
def r4(spark, d):
    return ct.source_metrics(frame(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id")), extractions(spark, d))


@query("r5_attribute_evidence", f"""WITH {_LONG}
  SELECT a.product_code, a.attribute, a.value AS master, count(l.v) AS n_evidence, count(DISTINCT l.v) > 1 AS conflict, coalesce(max(l.confidence), 1.0) AS top_confidence,
    md5(coalesce(string_agg(l.v || '|' || CAST(CAST(round(l.confidence * 100) AS INT) AS VARCHAR) || '|' || substr(CAST(l.source_id AS VARCHAR), 1, 8), ';' ORDER BY l.v, l.confidence, substr(CAST(l.source_id AS VARCHAR), 1, 8)),
    a.value || '|100|Truth Engine')) AS evidence_md5
  FROM fx_product_attributes a LEFT JOIN long l ON l.sku = a.product_code AND l.label = a.attribute GROUP BY 1, 2, 3""")
def r5(spark, d):
    rows = ct.attribute_evidence(frame(spark, d, "fx_product_attributes"), extractions(spark, d))
    line = lambda e: F.concat_ws("|", e["value"], F.round(e["confidence"] * 100).cast("int").cast("string"), e["source"])
    return rows.withColumn("evidence_md5", F.md5(F.array_join(F.transform("evidence", line), ";"))).drop("evidence")


@query("r6_golden_records", "SELECT p.product_code, p.brand_name, p.completeness_score, e.seo_title, e.confidence FROM fx_products p LEFT JOIN fx_enrichments e USING (product_id) WHERE enrichment_status = 'completed'")
def r6(spark, d):
    return ct.golden_records(frame(spark, d, "fx_products"), frame(spark, d, "fx_enrichments")).select("product_code", "brand_name", "completeness_score", "seo_title", "confidence")


@query("r7_publishable", "SELECT product_code, completeness_score FROM fx_products WHERE completeness_score >= 80 AND published_at IS NULL")
def r7(spark, d):
    return ct.publishable(frame(spark, d, "fx_products")).select("product_code", "completeness_score")


@query("r8_publish_record", "SELECT product_id, published_at IS NOT NULL OR product_id % 4 = 1 AS published, CASE WHEN product_id % 4 = 1 THEN 'published' END AS stage FROM fx_products")
def r8(spark, d):
    products = frame(spark, d, "fx_products")
    done, audit = ct.publish(products, products.where("product_id % 4 = 1").select("product_id"), F.lit("2024-06-01").cast("timestamp"))
    return done.join(audit, "product_id", "left").select("product_id", F.col("published_at").isNotNull().alias("published"), "stage")


@query("r9_dashboard_metrics", """SELECT * FROM (SELECT count(*) AS total_projects, count(*) FILTER (WHERE status = 'active') AS active_projects FROM fx_projects) a,
  (SELECT count(*) AS total_products, count(published_at) AS published_products, CAST(trunc(avg(completeness_score)) AS INT) AS catalog_health FROM fx_products) b""")
def r9(spark, d):
    return ct.dashboard_metrics(frame(spark, d, "fx_projects"), frame(spark, d, "fx_products"))


@query("r10_review_stats", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'rejected') AS rejected, CAST(0 AS BIGINT) AS in_review FROM fx_review_items""")
def r10(spark, d):
    return ct.review_stats(frame(spark, d, "fx_review_items"))


def keyed(spark, rows, key):
    t = KeyedTable(spark, shared_path(spark, "keyed"), key, rows.schema)
    t.update(rows, lambda old, new: old.unionByName(new))
    return t


@query("r4_source_metrics_merged", _R4)
def r4_merged(spark, d):
    """The states of half of the extractions are kept; those of the rest are added, by buckets."""
    rows = extractions(spark, d).select(F.concat_ws("-", "source_id", "l_orderkey", "l_linenumber").alias("extraction_id"), "source_id", "confidence", "attributes").dropDuplicates(["extraction_id"])
    stored = keyed(spark, rows.where("source_id % 2 = 0"), "extraction_id")
    sources = frame(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    mt.source_metrics(sources, stored)
    stored.update(rows.where("source_id % 2 = 1"), lambda old, new: old.unionByName(new))
    return mt.source_metrics(sources, stored)


@query("r9_product_metrics_merged", "SELECT count(*) AS total_products, count(*) FILTER (WHERE product_id % 3 = 0 OR product_id % 40 = 1) AS published_products, CAST(trunc(avg(CASE WHEN product_id % 40 = 1 THEN 0 ELSE completeness_score END)) AS INT) AS catalog_health FROM fx_products")
def r9_merged(spark, d):
    """The metrics of all products, and again after a fortieth was published with score zero: their buckets alone are read."""
    rows = frame(spark, d, "fx_products").select("product_id", "product_code", F.col("completeness_score").cast("int").alias("completeness_score"), "published_at")
    stored = keyed(spark, rows, "product_code")
    mt.product_metrics(stored)
    some = rows.where("product_id % 40 = 1").select("product_code", F.lit(0).alias("completeness_score"), F.lit("2024-02-01").cast("timestamp").alias("published_at"))
    stored.update(some, lambda old, new: ct.patch_rows(old, new, "product_code"))
    return mt.product_metrics(stored)


@query("r10_review_stats_merged", """SELECT count(*) AS total, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'approved') AS approved, count(*) FILTER (WHERE s = 'rejected') AS rejected,
  CAST(0 AS BIGINT) AS in_review FROM (SELECT CASE WHEN queue_id % 10 = 3 AND status = 'pending' THEN 'rejected' ELSE status END AS s FROM fx_review_items WHERE queue_id % 100 <> 7) x""")
def r10_merged(spark, d):
    rows = frame(spark, d, "fx_review_items").select("queue_id", "status")
    stored = keyed(spark, rows, "queue_id")
    mt.review_stats(stored)
    stored.update(rows.where("queue_id % 10 = 3 AND status = 'pending'").select("queue_id", F.lit("rejected").alias("status")), lambda old, new: ct.patch_rows(old, new, "queue_id"))
    stored.update(rows.where("queue_id % 100 = 7"), lambda old, new: ct.delete_rows(old, new, "queue_id"))
    return mt.review_stats(stored)


_CHOSEN = "chosen AS (SELECT * FROM fx_review_items WHERE status = 'pending' AND queue_id % 3 = 0)"


@query("r11_approve_items", f"""WITH {_CHOSEN}, last AS (SELECT product_code, attribute, arg_max(proposed_value, queue_id) AS nv FROM chosen GROUP BY 1, 2)
  SELECT product_code, attribute, coalesce(nv, value) AS value FROM fx_product_attributes FULL JOIN last USING (product_code, attribute)""")
def r11(spark, d):
    items = frame(spark, d, "fx_review_items")
    return ct.approve_items(items, frame(spark, d, "fx_product_attributes"), items.where("status = 'pending' and queue_id % 3 = 0"), ["queue_id"])[1]


_FIRST = "firsts AS (SELECT product_code, attribute, min(queue_id) AS queue_id FROM fx_review_items GROUP BY 1, 2)"


@query("r12_override_items", f"""WITH {_FIRST} SELECT i.queue_id, i.product_code, i.attribute, CASE WHEN h THEN 'approved' ELSE status END AS status, CASE WHEN h THEN 'qa' END AS reviewer,
    CASE WHEN h THEN 'fixed ' || i.product_code END AS overridden_value
  FROM (SELECT x.*, coalesce(f.queue_id = x.queue_id AND x.attribute = 'size', false) AS h FROM fx_review_items x LEFT JOIN firsts f USING (product_code, attribute)) i""")
def r12(spark, d):
    items = frame(spark, d, "fx_review_items")
    over = items.where("attribute = 'size'").select("product_code", "attribute", F.concat(F.lit("fixed "), "product_code").alias("value")).distinct()
    out = ct.override_items(items, frame(spark, d, "fx_product_attributes"), over, "qa")[0]
    return out.select("queue_id", "product_code", "attribute", "status", "reviewer", "overridden_value")


@query("r13_reject_items", f"""WITH {_FIRST} SELECT i.queue_id, CASE WHEN h THEN 'rejected' ELSE status END AS status, CASE WHEN h THEN 'qa' END AS reviewer
  FROM (SELECT x.*, coalesce(f.queue_id = x.queue_id AND x.attribute = 'type', false) AS h FROM fx_review_items x LEFT JOIN firsts f USING (product_code, attribute)) i""")
def r13(spark, d):
    items = frame(spark, d, "fx_review_items")
    return ct.reject_items(items, items.where("attribute = 'type'").select("product_code", "attribute").distinct(), "qa").select("queue_id", "status", "reviewer")


def rule_tables(spark, d):
    part = frame(spark, d, "part").withColumn("created_at", F.expr("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * p_size"))
    rule_id = F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id")
    old = part.where("p_partkey % 2 = 0").select(rule_id, F.col("p_type").alias("attribute_name"), F.lit("enum").alias("rule_type"), F.lit(True).alias("active"), "created_at")
    new = part.where("p_partkey % 3 = 0").select(rule_id, F.col("p_brand").alias("attribute_name"), F.when(F.col("p_partkey") % 4 == 0, None).otherwise("numeric").alias("rule_type"), F.lit(False).alias("active"), "created_at")
    return old, new


_RULES = """SELECT 'r' || CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS attribute_name,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 4 <> 0 THEN 'numeric' END ELSE 'enum' END AS rule_type, p_partkey % 3 <> 0 AS active,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * p_size AS created_at FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"""


@query("r14_sync_rules", _RULES)
def r14(spark, d):
    return ct.sync_rows(*rule_tables(spark, d), "rule_id")


@query("r15_list_rules", _RULES)
def r15(spark, d):
    return ct.newest(ct.sync_rows(*rule_tables(spark, d), "rule_id"), "created_at", "rule_id")


@query("r16_list_issues", "SELECT id, product_id, stage, logged_at FROM fx_audit WHERE stage = 'error'")
def r16(spark, d):
    return ct.newest(frame(spark, d, "fx_audit").where("stage = 'error'"), "logged_at", "id").select("id", "product_id", "stage", "logged_at")


@query("r17_resolve_issues", "SELECT id, product_id, stage = 'click' AS resolved FROM fx_audit")
def r17(spark, d):
    issues = frame(spark, d, "fx_audit").withColumn("resolved", F.lit(False))
    return ct.resolve_issues(issues, issues.where("stage = 'click'").select("id")).select("id", "product_id", "resolved")


@query("r18_audit_latest", "SELECT id, product_id, stage, logged_at FROM fx_audit ORDER BY logged_at DESC, id DESC LIMIT 100")
def r18(spark, d):
    return ct.audit_latest(frame(spark, d, "fx_audit")).select("id", "product_id", "stage", "logged_at")


@query("r19_products_page", "SELECT product_code, product_name, completeness_score FROM fx_products ORDER BY product_code LIMIT 100 OFFSET 50")
def r19(spark, d):
    return ct.page(frame(spark, d, "fx_products"), "product_code", 50).select("product_code", "product_name", "completeness_score")


@query("r19_page_of_ranges", "SELECT id, product_id, stage, logged_at FROM fx_audit ORDER BY logged_at, id LIMIT 100 OFFSET 700")
def r19_ranges(spark, d):
    """A page far into the audit trail in the order of its times: one or two ranges are read, not the trail."""
    rows = frame(spark, d, "fx_audit").select("id", "product_id", "stage", "logged_at")
    return RangedTable.write(rows, shared_path(spark, "ranges"), "logged_at", "id", rows_per_range=200).page(700)


@query("r20_get_by_key", "SELECT product_code, product_name, category_1 FROM fx_products WHERE product_id = 17")
def r20(spark, d):
    return ct.get_by_key(frame(spark, d, "fx_products"), "product_id", 17).select("product_code", "product_name", "category_1")


@query("r21_create_rows", """SELECT id, name, status FROM fx_projects UNION ALL SELECT s_suppkey + 10000000, s_name, CASE WHEN s_nationkey % 2 = 0 THEN 'draft' ELSE 'active' END FROM supplier""")
def r21(spark, d):
    new = frame(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 1, "active").alias("status"))
    return ct.create_rows(frame(spark, d, "fx_projects").drop("created_at"), new, {"status": "draft"})


@query("r22_patch_rows", """SELECT product_code, CASE WHEN product_id % 6 = 0 THEN 'New ' || product_name ELSE product_name END AS product_name,
  CASE WHEN product_id % 2 = 0 AND completeness_score > 50 THEN 100 ELSE completeness_score END AS completeness_score FROM fx_products""")
def r22(spark, d):
    products = frame(spark, d, "fx_products").select("product_code", "product_id", "product_name", "completeness_score")
    patches = products.where("product_id % 2 = 0").select(
        "product_code", F.when(F.col("product_id") % 6 == 0, F.concat(F.lit("New "), "product_name")).alias("product_name"), F.when(F.col("completeness_score") > 50, 100).alias("completeness_score")
    )
    return ct.patch_rows(products, patches, "product_code").drop("product_id")


@query("r22_keyed_updates", """SELECT product_code, CASE WHEN product_id % 50 = 1 THEN 'Patched' WHEN product_id % 50 = 2 THEN NULL ELSE product_name END AS product_name,
  CASE WHEN product_id % 50 = 1 THEN 'second' ELSE brand_name END AS brand_name, CAST(completeness_score AS INT) AS completeness_score FROM fx_products WHERE product_id % 50 <> 3
  UNION ALL SELECT 'N-' || product_code, product_name, NULL, 7 FROM fx_products WHERE product_id % 100 = 4""")
def r22_keyed(spark, d):
    """A table in buckets after patches (two for a key, nulls too), deletions and new rows."""
    columns = ["product_code", "product_name", "brand_name", F.col("completeness_score").cast("int").alias("completeness_score")]
    rows = frame(spark, d, "fx_products").select("product_id", *columns)
    stored = KeyedTable(spark, shared_path(spark, "keyed"), "product_code", rows.drop("product_id").schema)
    stored.update(rows.drop("product_id"), lambda old, new: old.unionByName(new))
    some = lambda k: rows.where(F.col("product_id") % 50 == k)
    patch = lambda k, name, brand, said, turn: some(k).select("product_code", F.lit(name).cast("string").alias("product_name"), F.lit(brand).cast("string").alias("brand_name"), F.array(*map(F.lit, said)).cast("array<string>").alias("said"), F.lit(turn).alias("turn"))
    patches = patch(1, "Patched", "first", ["product_name", "brand_name"], 1).unionByName(patch(1, None, "second", ["brand_name"], 2)).unionByName(patch(2, None, None, ["product_name"], 1))
    stored.update(patches, lambda old, new: ct.patch_rows(old, new, "product_code", "said", ["turn"]))
    stored.update(some(3).select("product_code"), lambda old, new: ct.delete_rows(old, new, "product_code"))
    fresh = rows.where("product_id % 100 = 4").select(F.concat(F.lit("N-"), "product_code").alias("product_code"), "product_name", F.lit(None).cast("string").alias("brand_name"), F.lit(7).alias("completeness_score"))
    stored.update(fresh, lambda old, new: ct.sync_rows(old, new, "product_code"))
    return stored.read()


@query("r23_delete_rows", "SELECT product_code, product_name FROM fx_products WHERE enrichment_status <> 'pending'")
def r23(spark, d):
    products = frame(spark, d, "fx_products")
    return ct.delete_rows(products, products.where("enrichment_status = 'pending'"), "product_code").select("product_code", "product_name")


@query("r24_list_projects", "SELECT id, name, status, created_at FROM fx_projects")
def r24(spark, d):
    return ct.newest(frame(spark, d, "fx_projects"), "created_at", "id")


@query("r25_publish_targets", "SELECT project_id, target_name, target_type, active FROM fx_targets WHERE project_id = '5'")
def r25(spark, d):
    return ct.of_project(frame(spark, d, "fx_targets"), "5")


@query("r26_first_of_product", "SELECT product_id, seo_title, confidence FROM fx_enrichments")
def r26(spark, d):
    return ct.first_of_product(frame(spark, d, "fx_enrichments"), "seo_title").select("product_id", "seo_title", "confidence")


@query("r26_standardized_for_product", f"WITH {values.chain('(SELECT * FROM fx_observations WHERE product_key = 17) q')} {values._FLAT}")
def r26s(spark, d):
    one = frame(spark, d, "fx_observations").where("product_key = 17")
    return values.flat(values.st.standardize(one, values.rules(spark).where("active")))


@query("r27_queue_size_per_product", "SELECT product_code, count(*) AS queue_size, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS attributes FROM fx_review_items WHERE status = 'pending' GROUP BY 1")
def r27(spark, d):
    return ct.queue_size_per_product(frame(spark, d, "fx_review_items"))


def identified(spark, d):
    rows = frame(spark, d, "fx_intake").select("row_no", F.col("sku").alias("mpn"), F.col("product_title").alias("title"))
    return gd.derive_identifiers(rows)


@query("g1_derive_identifiers", "SELECT row_no, coalesce(sku, '') AS mpn, coalesce(product_title, '') AS title, split_part(coalesce(product_title, ''), ' ', 1) AS brand FROM fx_intake")
def g1(spark, d):
    return identified(spark, d)


@query("g2_request_id", "SELECT row_no, substr(sha256(coalesce(sku, '') || coalesce(product_title, '') || '2024-01-01'), 1, 12) AS request_id FROM fx_intake")
def g2(spark, d):
    return identified(spark, d).select("row_no", gd.request_id(F.col("mpn"), F.col("title"), F.lit("2024-01-01")).alias("request_id"))


_GOLDEN = """SELECT p_partkey AS product_key, 'P-' || CAST(p_partkey AS VARCHAR) AS sku, coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_brand END, 'UNKNOWN') AS brand, coalesce(n, 0) AS n_attributes,
  coalesce(n, 0) >= 4 AND p_partkey % 11 <> 0 AS ready_for_publish, CAST(CASE WHEN coalesce(n, 0) > 0 THEN CASE WHEN n >= 5 THEN 0.7 ELSE 0.5 END END AS DOUBLE) AS confidence,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no_standardized_data' END AS error
  FROM part LEFT JOIN (SELECT product_key, count(DISTINCT attribute) AS n FROM {} GROUP BY 1) s ON s.product_key = p_partkey"""


def golden_products(spark, d):
    return frame(spark, d, "fx_products").select(F.col("product_id").alias("product_key"), F.col("product_code").alias("sku"), F.col("brand_name").alias("brand"))


@query("g3_build_golden_record", _GOLDEN.format("fx_observations"))
def g3(spark, d):
    return gd.build_golden_record(golden_products(spark, d), frame(spark, d, "fx_observations"))


@query("golden_records_by_part", f"WITH {values.chain()} " + _GOLDEN.format("done"))
def golden_records_by_part(spark, d):
    """Observations cleaned, deduplicated, resolved under the rules, and built into a record for each part."""
    return gd.build_golden_record(golden_products(spark, d), values.standardized(spark, d).where("status = 'ok'"))


_PROPOSAL = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"error":"x"}' WHEN 1 THEN '{"sku":"' || p_name || '","brand":"' || p_brand || '","attributes":{"a":"1"},"ready_for_publish":true}'
  WHEN 2 THEN '{"sku":"s","brand":"b","attributes":{},"ready_for_publish":true}' WHEN 3 THEN '{"sku":"s","brand":"b","attributes":{"a":"1"},"ready_for_publish":false,"identifiers":{"k":1}}' ELSE 'no json' END AS content FROM part"""


@query("g4_validate_golden", "SELECT p_partkey AS id, p_partkey % 5 = 1 AS valid FROM part")
def g4(spark, d):
    from lodestone.fixtures import sql_for_spark

    return gd.validate_golden(spark.sql(sql_for_spark(_PROPOSAL), part=frame(spark, d, "part"))).select("id", "valid")


@query("g7_completeness_score", "SELECT product_code, CAST(least(count(*) * 5, 100) AS INT) AS completeness_score FROM fx_product_attributes GROUP BY 1")
def g7(spark, d):
    return frame(spark, d, "fx_product_attributes").groupBy("product_code").agg(gd.completeness_score(F.count("*")).alias("completeness_score"))


@query("g8_upsert_product", """SELECT coalesce(p.product_code, f.code) AS product_code, coalesce(p.product_name, f.code) AS product_name, CASE WHEN p.product_code IS NULL THEN f.brand ELSE p.brand_name END AS brand_name,
  CASE WHEN f.code IS NOT NULL THEN 'completed' ELSE p.enrichment_status END AS enrichment_status, CASE WHEN f.code IS NOT NULL THEN 30 ELSE p.completeness_score END AS completeness_score
  FROM fx_products p FULL JOIN (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'N-' ELSE 'P-' END || CAST(p_partkey AS VARCHAR) AS code, p_brand AS brand FROM part WHERE p_partkey % 3 = 0) f ON f.code = p.product_code""")
def g8(spark, d):
    code = F.concat(F.when(F.col("p_partkey") % 9 == 0, "N-").otherwise("P-"), F.col("p_partkey").cast("string"))
    found = frame(spark, d, "part").where("p_partkey % 3 = 0").select(code.alias("product_code"), F.lit(None).cast("string").alias("title"), F.col("p_brand").alias("brand"), F.lit(6).alias("n_attributes"))
    return gd.upsert_product(frame(spark, d, "fx_products"), found)


@query("g9_append_audit", """SELECT product_id, stage, NULL AS sources_used, count(*) AS n FROM fx_audit GROUP BY 1, 2 UNION ALL
  SELECT CASE WHEN source_id % 7 = 0 THEN 'unknown' ELSE 'P-' || CAST(source_id AS VARCHAR) END, 'extraction', coalesce(nullif(source_url, ''), 'Manual Input'), count(*) FROM fx_kv_sources GROUP BY 1, 2, 3""")
def g9(spark, d):
    sku = F.when(F.col("source_id") % 7 != 0, F.concat(F.lit("P-"), F.col("source_id").cast("string"))).otherwise("")
    runs = frame(spark, d, "fx_kv_sources").select(sku.alias("sku"), "source_url")
    audit = frame(spark, d, "fx_audit").select("product_id", "stage", F.lit(None).cast("string").alias("sources_used"))
    return gd.append_audit(audit, runs).groupBy("product_id", "stage", "sources_used").agg(F.count("*").alias("n"))


@query("g10_insert_source_priority", """SELECT project_id, source_id, priority_rank, CAST(reliability_score AS DOUBLE) AS reliability_score FROM fx_priorities UNION ALL
  SELECT coalesce(project_id, 'default-project'), source_id, 1, CASE WHEN source_type = 'pdf' THEN 0.9 ELSE 0.7 END FROM fx_kv_sources WHERE source_id NOT IN (SELECT source_id FROM fx_priorities)""")
def g10(spark, d):
    return gd.insert_source_priority(frame(spark, d, "fx_priorities"), frame(spark, d, "fx_kv_sources"))


@query("g11_update_source_status", "SELECT source_id, CASE WHEN source_id % 10 = 0 THEN 'processing' WHEN source_id % 10 = 1 THEN 'failed' ELSE 'completed' END AS status FROM fx_kv_sources")
def g11(spark, d):
    sources = frame(spark, d, "fx_kv_sources").select("source_id", F.lit("processing").alias("status"))
    runs = sources.where("source_id % 10 <> 0").select("source_id", (F.col("source_id") % 10 == 1).alias("failed"))
    return gd.update_source_status(sources, runs)


@query("e1_enrichment_input", """SELECT product_code, coalesce(nullif(brand_name, ''), 'Generic') AS brand, coalesce(nullif(category_1, ''), 'Product') AS category,
  '{' || string_agg('"' || attribute || '":"' || value || '"', ',' ORDER BY attribute) || '}' AS attributes FROM fx_products JOIN fx_product_attributes USING (product_code) GROUP BY 1, 2, 3""")
def e1(spark, d):
    return en.enrichment_input(frame(spark, d, "fx_products"), frame(spark, d, "fx_product_attributes"))


def responses(spark, d):
    e = frame(spark, d, "fx_enrichments")
    many = lambda n, word: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(word), i.cast("string")))
    body = F.struct("seo_title", many(F.greatest(F.lit(1), F.col("n_bullets")), "b").alias("bullets"), many(F.lit(6), "t").alias("tags"), many(F.lit(3), "u").alias("use_cases"), "confidence")
    return e.select("product_id", "n_bullets", F.when(F.col("product_id") % 10 == 0, "not json").otherwise(F.to_json(body)).alias("content"))


@query("e2_validate_enrichment", "SELECT product_id, n_bullets = 5 AND product_id % 10 <> 0 AS valid FROM fx_enrichments")
def e2(spark, d):
    return en.validate_enrichment(responses(spark, d)).select("product_id", "valid")


@query("e3_use_case_map", """SELECT product_id, 'Use Case ' || CAST(i AS VARCHAR) AS name, 'u' || CAST(i AS VARCHAR) || ' ' || seo_title AS use_case FROM fx_enrichments, (SELECT unnest([1, 2, 3]) AS i) x""")
def e3(spark, d):
    cases = F.transform(F.array(F.lit("u1"), F.lit("u2"), F.lit("u3")), lambda u: F.concat_ws(" ", u, "seo_title"))
    return frame(spark, d, "fx_enrichments").select("product_id", F.explode(en.use_case_map(cases)).alias("name", "use_case"))


@query("e4_upsert_enrichment", """SELECT p.product_id, CASE WHEN p.product_id % 3 = 0 THEN 'new' ELSE e.seo_title END AS seo_title, CASE WHEN p.product_id % 3 = 0 THEN 'completed' ELSE enrichment_status END AS enrichment_status
  FROM fx_products p LEFT JOIN fx_enrichments e USING (product_id)""")
def e4(spark, d):
    products = frame(spark, d, "fx_products").select("product_id", "enrichment_status")
    incoming = products.where("product_id % 3 = 0").select("product_id", F.lit("new").alias("seo_title"))
    rows, done = en.upsert_enrichment(frame(spark, d, "fx_enrichments").select("product_id", "seo_title"), incoming, products)
    return done.join(rows, "product_id", "left").select("product_id", "seo_title", "enrichment_status")


@query("e5_enrichment_review_flag", "SELECT product_id, confidence, confidence < 0.8 AS review_required FROM fx_enrichments")
def e5(spark, d):
    return en.enrichment_review_flag(frame(spark, d, "fx_enrichments")).select("product_id", "confidence", "review_required")
