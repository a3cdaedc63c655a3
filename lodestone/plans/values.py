"""Registered queries on observed values: cleaning (C) and standardization (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.fixtures import frame, with_views
from lodestone.functions import text as tx
from lodestone.operators import cleaning, standardize as st
from lodestone.operators import synonyms as sy
from lodestone.schemas import EXAMPLE_RULES, INVALID_VALUES, RULES_SCHEMA, SOURCE_CONFIDENCE

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return keep


def norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def clean(x: str) -> str:
    return f"trim(replace(replace(replace(replace({norm(x)}, '&quot;', '\"'), '&apos;', ''''), '&#34;', '\"'), '&#39;', ''''))"


def invalid(x: str) -> str:
    return f"(lower(trim({norm(x)})) IN ({', '.join(repr(v) for v in INVALID_VALUES)}))"


def conf(x: str) -> str:
    return "CASE " + x + "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in SOURCE_CONFIDENCE.items()) + " ELSE CAST(0.5 AS DOUBLE) END"


_P1, _P2, _P3 = r"([0-9,]+\.?[0-9]*)\s*([a-zA-Z]+)", r"([0-9,]+\.?[0-9]*)\s*([\"′″])", r"([0-9,]+\.?[0-9]*)$"


def number(x: str) -> str:
    one = lambda p: f"TRY_CAST(nullif(replace(regexp_extract({x}, '{p}', 1), ',', ''), '') AS DOUBLE)"
    return f"coalesce({one(_P1)}, {one(_P2)}, {one(_P3)})"


def unit(x: str) -> str:
    one = lambda p: f"TRY_CAST(nullif(replace(regexp_extract({x}, '{p}', 1), ',', ''), '') AS DOUBLE)"
    name = lambda p: f"CASE WHEN lower(regexp_extract({x}, '{p}', 2)) IN ('\"', '″', 'inch') THEN 'inches' ELSE lower(regexp_extract({x}, '{p}', 2)) END"
    return f"CASE WHEN {one(_P1)} IS NOT NULL THEN {name(_P1)} WHEN {one(_P2)} IS NOT NULL THEN {name(_P2)} END"


def sim(a: str, b: str) -> str:
    """The ratio of matching blocks for values that differ by insertions or by substitutions, as those of the views do."""
    return f"({a} = {b} OR 2.0 * (greatest(length({a}), length({b})) - levenshtein({a}, {b})) >= 0.9 * (length({a}) + length({b})) - 1e-9)"


def observations(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "fx_observations")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE_RULES, RULES_SCHEMA)


RULES_SQL = """rules AS (SELECT * FROM (VALUES
 ('grade', 'enum', ['Grade A', 'Grade B', 'Grade C'], NULL, NULL, NULL, false), ('width', 'numeric', NULL, 2.0, 45.0, 'inches', false),
 ('extras', NULL, NULL, NULL, NULL, NULL, true)) AS r(attribute, type, allowed, low_bound, high_bound, rule_unit, multi_value))"""


@query("c1_normalize_text", f"SELECT doc_id, md5({norm('text')}) AS normalized FROM documents")
def c1(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("normalized"))


@query("c2_is_invalid", f"SELECT value, count(*) AS n FROM fx_observations WHERE {invalid('value')} GROUP BY value")
def c2(spark, d):
    return observations(spark, d).where(tx.is_invalid(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))


@query("c3_extract_number", "SELECT value, TRY_CAST(nullif(regexp_extract(value, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS number, count(*) AS n FROM fx_observations GROUP BY 1, 2")
def c3(spark, d):
    return observations(spark, d).groupBy("value", tx.extract_number(F.col("value")).alias("number")).agg(F.count("*").alias("n"))


@query("c4_clean_value", f"SELECT product_key, attribute, pos, {clean('value')} AS cleaned FROM fx_observations")
def c4(spark, d):
    return observations(spark, d).select("product_key", "attribute", "pos", tx.clean_value(F.col("value")).alias("cleaned"))


@query("c5_number_and_unit", f"SELECT v AS value, {number('v')} AS number, {unit('v')} AS unit, count(*) AS n FROM (SELECT {clean('value')} AS v FROM fx_observations) x GROUP BY 1, 2, 3")
def c5(spark, d):
    q = tx.number_and_unit(F.col("value"))
    rows = observations(spark, d).withColumn("value", tx.clean_value(F.col("value")))
    return rows.groupBy("value", q["number"].alias("number"), q["unit"].alias("unit")).agg(F.count("*").alias("n"))


CLEANED = f"""cleaned AS (SELECT *, CASE WHEN {invalid('value')} THEN 'invalid' WHEN row_number() OVER (
  PARTITION BY product_key, attribute, {invalid('value')}, lower({norm('value')}) ORDER BY pos) > 1 THEN 'duplicate' ELSE 'valid' END AS status,
  {norm('value')} AS normalized FROM fx_observations)"""


@query("c6_clean_attribute", f"WITH {CLEANED} SELECT product_key, attribute, pos, value, source, normalized, status FROM cleaned")
def c6(spark, d):
    return cleaning.clean_attribute(observations(spark, d))


@query("c7_clean_table", f"WITH {CLEANED} SELECT product_key, attribute, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status <> 'valid') AS n_removed FROM cleaned GROUP BY 1, 2")
def c7(spark, d):
    valid = F.col("status") == "valid"
    return cleaning.clean_attribute(observations(spark, d)).groupBy("product_key", "attribute").agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_removed"))


@query("c8_removed_values", f"WITH {CLEANED} SELECT product_key, attribute, pos, value, source, status AS reason FROM cleaned WHERE status <> 'valid'")
def c8(spark, d):
    return cleaning.removed_values(cleaning.clean_attribute(observations(spark, d)))


def attributes(spark, d):
    return frame(spark, d, "fx_product_attributes")


_BARE = "trim(replace(replace(value, '$', ''), ',', ''))"
_NUM = rf"CASE WHEN regexp_matches({_BARE}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({_BARE} AS DOUBLE) END"
_ISSUE = "SELECT product_code, attribute, 'invalid' AS issue_type, {} AS details, false AS resolved FROM fx_product_attributes WHERE {}"
_C9 = _ISSUE.format("'Placeholder detected: ''' || value || ''''", invalid("value"))
_C10 = _ISSUE.format("'Price must be a positive number'", f"lower(attribute) LIKE '%price%' AND {_NUM} <= 0")
_C11 = _ISSUE.format("'Non-numeric price found: ' || value", f"lower(attribute) LIKE '%price%' AND {_NUM} IS NULL")


@query("c9_issue_placeholder", _C9)
def c9(spark, d):
    return cleaning.issue_placeholder(attributes(spark, d))


@query("c10_issue_price_nonpositive", _C10)
def c10(spark, d):
    return cleaning.issue_price_nonpositive(attributes(spark, d))


@query("c11_issue_price_nonnumeric", _C11)
def c11(spark, d):
    return cleaning.issue_price_nonnumeric(attributes(spark, d))


@query("c12_detect_issues", f"{_C9} UNION ALL {_C10} UNION ALL {_C11}")
def c12(spark, d):
    return cleaning.detect_issues(attributes(spark, d))


@query("d1_source_confidence", f"SELECT source, CAST({conf('source')} AS DOUBLE) AS confidence, count(*) AS n FROM fx_observations GROUP BY 1, 2")
def d1(spark, d):
    return observations(spark, d).groupBy("source", tx.source_confidence(F.col("source")).alias("confidence")).agg(F.count("*").alias("n"))


def chain(source: str = "fx_observations") -> str:
    """The steps of standardization in SQL, over observations of ``source``."""
    return f"""{RULES_SQL},
 cleaned AS (SELECT product_key, attribute, pos, {clean('value')} AS value, source FROM {source}),
 firsts AS (SELECT *, lower(value) AS low, {conf('source')} AS conf, {number('value')} AS num, {unit('value')} AS unit FROM (
   SELECT *, row_number() OVER (PARTITION BY product_key, attribute, lower(value) ORDER BY pos) AS rn FROM cleaned WHERE value <> '') x WHERE rn = 1),
 lists AS (SELECT product_key, attribute, list({{'pos': pos, 'value': value, 'low': low, 'source': source, 'conf': conf, 'num': num, 'unit': unit}} ORDER BY pos) AS vals
   FROM firsts GROUP BY 1, 2),
 kept AS (SELECT product_key, attribute, unnest(list_reduce(list_transform(vals, lambda v: [v]), lambda acc, x:
   CASE WHEN len(list_filter(acc, lambda k: {sim('x[1].low', 'k.low')})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS v FROM lists),
 ordered AS (SELECT product_key, attribute, list(v ORDER BY v.conf DESC, v.pos) AS vals FROM kept GROUP BY 1, 2),
 nums AS (SELECT *, list_filter(vals, lambda v: v.num IS NOT NULL) AS nv FROM ordered),
 clustered AS (SELECT *, CASE WHEN len(nv) > 0 THEN list_reduce(list_transform(nv, lambda v: [{{'seed': v.num, 'weight': v.conf, 'value': v.value, 'n': 1}}]), lambda acc, x:
   CASE WHEN len(list_filter(acc, lambda c: abs(x[1].seed - c.seed) / (CASE WHEN c.seed = 0 THEN 1.0 ELSE c.seed END) <= 0.05)) > 0
   THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda e: abs(x[1].seed - e.seed) / (CASE WHEN e.seed = 0 THEN 1.0 ELSE e.seed END) <= 0.05), true)
     THEN {{'seed': c.seed, 'weight': c.weight + x[1].weight, 'value': c.value, 'n': c.n + 1}} ELSE c END)
   ELSE list_concat(acc, x) END) END AS clusters FROM nums),
 best AS (SELECT *, list_filter(clusters, lambda c: c.weight = list_max(list_transform(clusters, lambda e: e.weight)))[1] AS b, nv[1] AS h FROM clustered),
 resolved AS (SELECT *, CASE WHEN len(nv) = 0 THEN vals[1].value WHEN abs(b.seed - h.num) / (CASE WHEN h.num = 0 THEN 1.0 ELSE h.num END) > 0.1 THEN b.value ELSE h.value END AS chosen,
   CASE WHEN len(nv) = 0 THEN 'Highest confidence source: ' || vals[1].source WHEN abs(b.seed - h.num) / (CASE WHEN h.num = 0 THEN 1.0 ELSE h.num END) > 0.1
     THEN 'Consensus from ' || CAST(b.n AS VARCHAR) || ' sources' ELSE 'Highest confidence source: ' || h.source END AS reason FROM best),
 conflicted AS (SELECT *, CASE WHEN len(nv) = 0 THEN list_transform(vals[2:], lambda v: v.value)
   ELSE list_transform(list_filter(nv, lambda v: v.value <> chosen), lambda v: v.value) END AS conflicts FROM resolved),
 matched AS (SELECT c.*, r.type, r.low_bound, r.high_bound, r.rule_unit, r.multi_value,
   CASE WHEN r.type = 'enum' THEN flatten(list_transform(vals, lambda v: list_transform(list_filter(r.allowed, lambda a: contains(v.low, lower(a))), lambda a: {{'a': a, 'conf': v.conf}})))[1] END AS m,
   {number('chosen')} AS cnum, {unit('chosen')} AS cunit FROM conflicted c LEFT JOIN rules r USING (attribute)),
 kinds AS (SELECT *, CASE WHEN coalesce(multi_value, false) THEN 'multi' WHEN m IS NOT NULL THEN 'enum' WHEN type = 'numeric' AND cnum IS NOT NULL THEN 'numeric'
   WHEN type = 'numeric' THEN 'unparsed' ELSE 'default' END AS kind, list_sort(list_distinct(list_transform(vals, lambda v: v.value))) AS uniq FROM matched),
 done AS (SELECT product_key, attribute,
   CASE kind WHEN 'multi' THEN array_to_string(uniq, ', ') WHEN 'enum' THEN m.a WHEN 'numeric' THEN NULL ELSE chosen END AS standard_value,
   CASE WHEN kind = 'numeric' THEN greatest(least(cnum, high_bound), low_bound) END AS standard_number,
   CASE WHEN kind = 'numeric' THEN coalesce(cunit, rule_unit) END AS unit, array_to_string(list_transform(vals, lambda v: v.source), ',') AS derived_from,
   CASE kind WHEN 'multi' THEN round(list_sum(list_transform(vals, lambda v: round(v.conf * 100))) / len(vals)) / 100 WHEN 'enum' THEN least(m.conf + 0.05, 1.0) WHEN 'unparsed' THEN 0.5 ELSE vals[1].conf END AS confidence,
   CASE kind WHEN 'multi' THEN 'Aggregated ' || CAST(len(uniq) AS VARCHAR) || ' unique values' WHEN 'enum' THEN 'Matched allowed enum: ' || m.a
     WHEN 'unparsed' THEN 'Failed to parse numeric value, stored as string' ELSE reason END AS reason,
   CASE kind WHEN 'enum' THEN array_to_string(list_transform(list_filter(vals, lambda v: v.value <> m.a), lambda v: v.value), '|') WHEN 'numeric' THEN array_to_string(conflicts, '|')
     WHEN 'default' THEN array_to_string(conflicts, '|') END AS conflicts, kind FROM kinds)"""


def flat(done: DataFrame) -> DataFrame:
    return done.select(
        "product_key", "attribute", "standard_value", "standard_number", "unit", F.array_join("derived_from", ",").alias("derived_from"),
        F.round("confidence", 4).alias("confidence"), "reason", F.array_join("conflicts", "|").alias("conflicts"),
    )


_FLAT = "SELECT product_key, attribute, standard_value, standard_number, unit, derived_from, round(confidence, 4) AS confidence, reason, conflicts FROM done"


@query("d2_values_are_similar", f"""WITH v AS (SELECT DISTINCT attribute, lower({clean('value')}) AS low FROM fx_observations)
  SELECT a.attribute, a.low AS a, b.low AS b FROM v a JOIN v b ON a.attribute = b.attribute AND a.low < b.low WHERE {sim('a.low', 'b.low')}""")
def d2(spark, d):
    return st.similar_values(observations(spark, d))


@query("d3_deduplicate_values", f"WITH {chain()} SELECT product_key, attribute, v.pos AS pos, v.value AS value FROM kept")
def d3(spark, d):
    kept = st.dissimilar_lists(observations(spark, d)).select("product_key", "attribute", F.explode("vals").alias("v"))
    return kept.select("product_key", "attribute", "v.pos", "v.value")


def ordered(spark, d):
    return st.dissimilar_lists(observations(spark, d)).withColumn("vals", st.by_confidence(F.col("vals")))


@query("d4_numeric_clusters", f"WITH {chain()} SELECT product_key, attribute, c.seed AS seed, round(c.weight, 4) AS weight, c.value AS value, CAST(c.n AS INT) AS n FROM (SELECT product_key, attribute, unnest(clusters) AS c FROM clustered) x")
def d4(spark, d):
    rows = ordered(spark, d).select("product_key", "attribute", F.explode(st.numeric_clusters(F.filter("vals", lambda v: v["number"].isNotNull()))).alias("c"))
    return rows.select("product_key", "attribute", "c.seed", F.round("c.weight", 4).alias("weight"), "c.value", "c.n")


def resolved(spark, d):
    return st.resolve(ordered(spark, d)).withColumn("numeric", F.exists("vals", lambda v: v["number"].isNotNull()))


_RESOLVED = f"WITH {chain()} SELECT product_key, attribute, chosen, reason, array_to_string(conflicts, '|') AS conflicts FROM conflicted WHERE len(nv) "


@query("d5_resolve_conflicts_numeric", _RESOLVED + "> 0")
def d5(spark, d):
    return resolved(spark, d).where("numeric").select("product_key", "attribute", "chosen", "reason", F.array_join("conflicts", "|").alias("conflicts"))


@query("d6_resolve_conflicts_text", _RESOLVED + "= 0")
def d6(spark, d):
    return resolved(spark, d).where("not numeric").select("product_key", "attribute", "chosen", "reason", F.array_join("conflicts", "|").alias("conflicts"))


def standardized(spark, d):
    return st.standardize(observations(spark, d), rules(spark).where("active").drop("active", "rule_id"))


for _name, _where in (
    ("d7_std_multi_value", "attribute = 'extras'"), ("d8_std_enum", "attribute = 'grade'"), ("d9_std_numeric", "attribute = 'width'"),
    ("d10_std_default", "attribute = 'finish'"), ("d11_standardize_attribute", "true"),
):
    query(_name, f"WITH {chain()} {_FLAT} WHERE {_where}")(lambda spark, d, w=_where: flat(standardized(spark, d).where("status = 'ok'").where(w)))


@query("d12_active_rules", f"WITH {RULES_SQL}, o AS (SELECT attribute, count(*) AS n_observations FROM fx_observations GROUP BY 1) SELECT attribute, type, rule_unit AS unit, n_observations FROM rules JOIN o USING (attribute)")
def d12(spark, d):
    n = observations(spark, d).groupBy("attribute").agg(F.count("*").alias("n_observations"))
    return n.join(F.broadcast(st.active_rules(rules(spark))), "attribute").select("attribute", "type", "unit", "n_observations")


_CAT = "(SELECT product_code AS product_key, attribute, 0 AS pos, value, 'truth_engine' AS source FROM fx_product_attributes)"


@query("d13_standardize_catalog", f"WITH {chain(_CAT + ' q')} SELECT product_key AS product_code, attribute, 'ok' AS status, standard_value, 'string' AS standard_format, round(confidence, 4) AS confidence FROM done")
def d13(spark, d):
    old = spark.createDataFrame([], "product_code string, attribute string, status string, standard_value string, standard_format string, confidence double")
    return st.standardize_catalog(attributes(spark, d), rules(spark).where("active"), old).withColumn("confidence", F.round("confidence", 4))


@query("d14_route_to_review", f"WITH {chain()} SELECT product_key, attribute, round(confidence, 4) AS confidence, confidence < 0.85 AS review, CASE WHEN confidence < 0.85 THEN 'Low Confidence: ' ELSE '' END || reason AS reason FROM done")
def d14(spark, d):
    keep, review = st.route_to_review(standardized(spark, d).where("status = 'ok'"))
    both = keep.withColumn("review", F.lit(False)).unionByName(review.withColumn("review", F.lit(True)))
    return both.select("product_key", "attribute", F.round("confidence", 4).alias("confidence"), "review", "reason")


_VALID = f"(SELECT product_key, attribute, pos, {norm('value')} AS value, source FROM (SELECT *, row_number() OVER (PARTITION BY product_key, attribute, lower({norm('value')}) ORDER BY pos) AS r FROM fx_observations WHERE NOT {invalid('value')}) y WHERE r = 1)"


@query("d15_standardize_payload", f"WITH {chain(_VALID + ' q')} SELECT product_key, count(*) AS n_attributes, bool_or(confidence < 0.85) AS review_required, count(*) FILTER (WHERE confidence < 0.85) AS queue_size FROM done GROUP BY 1")
def d15(spark, d):
    return st.standardize_payload(observations(spark, d), rules(spark).where("active"))


def extracted(spark, d, rows_per_task: int = 500_000):
    """Label and value of each raw extraction, long. Rows are dealt out by product in parts of a fixed size, in which repeated
    ones are found: a part of a file has more different rows than a task's memory should hold."""
    parts = -(-frame(spark, d, "lineitem").count() // rows_per_task)
    raw = frame(spark, d, "fx_raw_extractions").repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sku")
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).alias("value")) for label, c in (("Size", "attr_size"), ("Product Type", "attr_type"), ("Flag", "attr_flag"))])
    rows = raw.select(F.col("sku").alias("product_key"), "source_id", F.explode(pairs).alias("p")).where("p.value is not null")
    return rows.select("product_key", F.col("source_id").alias("source_pos"), "p.label", "p.value", F.col("source_id").cast("string").alias("source")).distinct()


_EXTRACTED = """extracted AS (SELECT DISTINCT sku AS product_key, source_id AS source_pos, label, value, CAST(source_id AS VARCHAR) AS source FROM (
  SELECT sku, source_id, 'Size' AS label, attr_size AS value FROM fx_raw_extractions UNION ALL SELECT sku, source_id, 'Product Type', attr_type FROM fx_raw_extractions
  UNION ALL SELECT sku, source_id, 'Flag', attr_flag FROM fx_raw_extractions) x WHERE value IS NOT NULL),
 unified AS (SELECT DISTINCT e.label, coalesce(s.canonical, trim(regexp_replace(lower(e.label), '[^a-z0-9]+', '_', 'g'), '_')) AS canonical, CAST(coalesce(s.confidence, 1.0) AS DOUBLE) AS confidence
   FROM extracted e LEFT JOIN fx_synonyms s ON e.label = s.label)"""


@query("d16_unify_attributes", f"WITH {_EXTRACTED} SELECT label, canonical, confidence FROM unified")
def d16(spark, d):
    return st.unify_attributes(extracted(spark, d), frame(spark, d, "fx_synonyms"))


#: Labels of at most 256 different values: their containment is exact.
_FORMS = f"""forms AS (SELECT DISTINCT label, CASE WHEN regexp_matches(v, '{sy.QUANTITY}') AND {number('v')} IS NOT NULL THEN concat_ws(' ', CAST({number('v')} AS VARCHAR), {unit('v')}) ELSE v END AS form
  FROM (SELECT label, lower({clean('value')}) AS v FROM fx_labelled_values WHERE label <> 'Name') x),
 held AS (SELECT a.label, b.label AS other, count(*) AS shared FROM forms a JOIN forms b ON a.form = b.form AND a.label <> b.label GROUP BY 1, 2),
 contained AS (SELECT label, other, shared, n AS compared, shared / n AS containment FROM held JOIN (SELECT label, count(*) AS n FROM forms GROUP BY 1) c USING (label) WHERE shared >= 3 AND shared >= 0.8 * n - 1e-9)"""


@query("d16_label_containment", f"WITH {_FORMS} SELECT label, other, shared, compared, containment FROM contained")
def d16_containment(spark, d):
    return sy.label_containment(frame(spark, d, "fx_labelled_values"))


@query("d16_discover_synonyms", f"""WITH {_FORMS} SELECT label, canonical, confidence FROM (
  SELECT label, 'width' AS canonical, containment AS confidence FROM contained WHERE other = 'Size'
  UNION ALL SELECT label, 'brand', containment FROM contained WHERE label = 'Maker' AND other = 'Brand') x WHERE label <> 'Size'""")
def d16_discover(spark, d):
    """'Size' is known as 'width'; what its values and those of 'Brand' hold gets their names, other labels none."""
    return sy.discovered_synonyms(frame(spark, d, "fx_labelled_values"), frame(spark, d, "fx_synonyms"))


_GATHERED = f"""{_EXTRACTED}, gathered AS (SELECT product_key, canonical AS attribute, row_number() OVER (PARTITION BY product_key, canonical ORDER BY source_pos, label, value) AS pos, value, source
  FROM extracted JOIN unified USING (label))"""


def gathered(spark, d):
    rows = extracted(spark, d)
    return st.gather_canonical_values(rows, st.unify_attributes(rows, frame(spark, d, "fx_synonyms")))


@query("d17_gather_canonical_values", f"WITH {_GATHERED} SELECT product_key, attribute, pos, value, source FROM gathered")
def d17(spark, d):
    return gathered(spark, d)


_FORM = f"CASE WHEN {number('v')} IS NOT NULL THEN concat_ws(' ', CAST({number('v')} AS VARCHAR), {unit('v')}) ELSE lower(v) END"


@query("d18_canonical_conflict", f"""SELECT product_key, attribute, count(*) AS n_values, count(DISTINCT {_FORM}) AS n_forms, count(DISTINCT {_FORM}) > 1 AS conflict
  FROM (SELECT product_key, attribute, {clean('value')} AS v FROM fx_observations) x GROUP BY 1, 2""")
def d18(spark, d):
    return st.canonical_conflict(observations(spark, d))


@query("d19_pick_truth", f"WITH {_GATHERED}, {chain('gathered')} {_FLAT}")
def d19(spark, d):
    return flat(st.standardize(gathered(spark, d), rules(spark).where("active")).where("status = 'ok'"))
