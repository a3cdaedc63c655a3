"""Exact semantics of text functions, cleaning, standardization and the fold over similar values."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import cleaning, enrich, extract, standardize as st
from lodestone.operators.model_hook import safe_apply, similarity_ratio
from lodestone.plans import values
from lodestone.schemas import RULES_SCHEMA
from lodestone.streaming import ingest

RULES = [
    ("r1", "grade", "enum", ["Grade A", "Grade B"], None, None, None, False, True), ("r2", "size", "numeric", None, 1.0, 100.0, "inches", False, True),
    ("r3", "tags", None, None, None, None, None, True, True),
]


def observe(spark, attribute, values):
    return spark.createDataFrame([(1, attribute, i, v, s) for i, (v, s) in enumerate(values)], "product_key long, attribute string, pos long, value string, source string")


def standard(spark, attribute, values):
    return st.standardize(observe(spark, attribute, values), spark.createDataFrame(RULES, RULES_SCHEMA)).first()


@pytest.mark.parametrize(("value", "number", "unit"), [
    ("1,200.5 kg", 1200.5, "kg"), ('12"', 12.0, "inches"), ("12 IN", 12.0, "in"), ("7", 7.0, None), ("12 inch", 12.0, "inches"), ("Red, blue 12 inch", None, None), ("no digits", None, None), ("5′", 5.0, "′"),
])
def test_number_and_unit(spark, value, number, unit):
    r = spark.createDataFrame([(value,)], "v string").select(tx.number_and_unit(F.col("v")).alias("q")).first().q
    assert (r.number, r.unit) == (number, unit)


def test_text_functions(spark):
    df = spark.createDataFrame([(" a   b ", "5&quot;  wide", "x12.5y7"), ("\tTBD\n", "‘q’", "none"), (None, "", "")], "a string, b string, c string")
    rows = df.select(tx.normalize_text(F.col("a")).alias("n"), tx.is_invalid(F.col("a")).alias("i"), tx.clean_value(F.col("b")).alias("c"), tx.clean_value(F.col("b"), True).alias("cq"), tx.extract_number(F.col("c")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("a b", False, '5" wide', '5" wide', 12.5), ("TBD", True, "‘q’", "'q'", None), (None, True, "", "", None)]


def test_clean_attribute(spark):
    rows = cleaning.clean_attribute(observe(spark, "a", [(v, "web") for v in (" A  b ", "a B", "N/A", "tbd", "c", None)])).orderBy("pos").collect()
    assert [r.status for r in rows] == ["valid", "duplicate", "invalid", "invalid", "valid", "invalid"]
    assert rows[0].normalized == "A b" and rows[1].value == "a B"


def test_issues(spark):
    rows = [("p", "price", v) for v in ("N/A", "$0", "$1,200", "12f")]
    got = Counter(r.details for r in cleaning.detect_issues(spark.createDataFrame(rows, "product_code string, attribute string, value string")).collect())
    assert got == {"Placeholder detected: 'N/A'": 1, "Non-numeric price found: N/A": 1, "Price must be a positive number": 1, "Non-numeric price found: 12f": 1}


def test_dissimilar_values_are_kept_in_order(spark):
    lists = st.value_lists(observe(spark, "a", [(v, "web") for v in ("deep blue", "deep bluee", "black")]))
    kept = lists.select(st.keep_dissimilar("vals").alias("k")).first().k
    assert [k.value for k in kept] == ["deep blue", "black"]


def test_dissimilar_values_match_a_plain_fold(spark):
    draw = random.Random(9)
    stems = ["black", "graphite", "bluetooth", "deep blue", "usb port", "", "x"]
    lists = [[draw.choice(stems) + draw.choice(["", "s", " 5", "er", " x"]) for _ in range(draw.randint(1, 12))] for _ in range(60)]
    rows = [(k, "a", i, v, "web") for k, values in enumerate(lists) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "product_key long, attribute string, pos long, value string, source string")
    got = {r.product_key: [x.value for x in r.k or []] for r in st.value_lists(df).select("product_key", st.keep_dissimilar("vals").alias("k")).collect()}
    for k, values in enumerate(lists):
        kept = []
        for v in (" ".join(x.split()) for x in values):
            if v and not any(SequenceMatcher(None, v, seen).ratio() >= 0.9 for seen in kept):
                kept.append(v)
        assert got[k] == kept
    distinct = sorted({" ".join(v.split()) for values in lists for v in values})
    want = {(a, b) for a in distinct for b in distinct if a < b and SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert {(r.a, r.b) for r in st.similar_values(df).collect()} == want


def test_conflicts(spark):
    a = standard(spark, "other", [("10 in", "vendor"), ("20 in", "manufacturer"), ("10.2 in", "web")])
    assert (a.standard_value, a.reason) == ("10.2 in", "Consensus from 2 sources")
    b = standard(spark, "other", [("10 in", "manufacturer"), ("11 in", "web")])
    assert (b.standard_value, b.reason, b.conflicts) == ("10 in", "Highest confidence source: manufacturer", ["11 in"])


def test_rules(spark):
    a = standard(spark, "grade", [("Sold as grade b", "web")])
    assert (a.standard_value, round(a.confidence, 4), a.conflicts) == ("Grade B", 0.75, ["Sold as grade b"])
    b = standard(spark, "size", [("150 inch", "web")])
    assert (b.standard_number, b.unit, b.confidence) == (100.0, "inches", 0.7)
    c = standard(spark, "size", [("large", "web")])
    assert (c.standard_value, c.confidence) == ("large", 0.5)
    d = standard(spark, "tags", [("b", "web"), ("a", "vendor"), ("B", "web")])
    assert (d.standard_value, d.reason) == ("a, b", "Aggregated 2 unique values")
    assert standard(spark, "size", [("  ", "web")]).status == "error"


def test_clusters_match_a_plain_loop(spark):
    draw = random.Random(4)
    for _ in range(5):
        values = [(f"{draw.choice([10, 10.3, 10.6, 11, 20, 20.5])} in", draw.choice(["web", "vendor", "manufacturer"])) for _ in range(9)]
        got = st.value_lists(observe(spark, "a", values)).select(st.numeric_clusters(F.col("vals")).alias("c"), "vals").first()
        clusters = {}
        for v in got.vals:
            seed = next((k for k in clusters if abs(v.number - k) / (k or 1) <= 0.05), None)
            clusters.setdefault(v.number if seed is None else seed, []).append(v)
        assert [(c.seed, c.n) for c in got.c] == [(k, len(v)) for k, v in clusters.items()]


def test_user_function_never_fails_the_job(spark):
    def call(text):
        if text == "boom":
            raise ValueError("no")
        return {"n": len(text)} if text != "list" else [1]

    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "list"), (4, " "), (5, None)], "id long, t string")
    got = {r.id: (r.ok, r.value_json, r.error) for r in safe_apply(df, "id", "t", call).collect()}
    assert got == {1: (True, '{"n": 3}', None), 2: (False, None, "llm_exception"), 3: (False, None, "invalid_response"), 4: (False, None, "empty_prompt"), 5: (False, None, "empty_prompt")}
    assert safe_apply(df.where("id = 2"), "id", "t", call, lambda t: {"b": 1}).first().value_json == '{"b": 1}'
    assert abs(spark.createDataFrame([("deep bluee", "deep blue")], "a string, b string").select(similarity_ratio(F.col("a"), F.col("b"))).first()[0] - 18 / 19) < 1e-9


def test_enrichment_input_of_repeated_attributes(spark):
    products = spark.createDataFrame([("p", None, "c"), ("q", "b", "")], "product_code string, brand_name string, category_1 string")
    attributes = spark.createDataFrame([("p", "size", "2"), ("p", "size", "1"), ("p", "hue", None)], "product_code string, attribute string, value string")
    got = {tuple(r) for r in enrich.enrichment_input(products, attributes).collect()}
    assert got == {("p", "Generic", "c", '{"hue":null,"size":"1"}'), ("q", "b", "Product", "{}")}


def test_linked_data_with_quotes_in_keys(spark):
    page = """<script type="application/ld+json">{"@type": "Product", "maker's name": "O'Neil", "a.b['x']": 5, "offers": {"p": 1}, "none": null}</script>"""
    got = {(r.label, r.value) for r in extract.jsonld_product_pairs(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()}
    assert {v for _, v in got} == {"O'Neil", "5"} and len(got) == 2


def test_versions_of_a_broken_folder_are_no_empty_catalog(spark, tmp_path):
    assert ingest.latest_version(spark, str(tmp_path / "none")) == -1
    (tmp_path / "versions").mkdir()
    (tmp_path / "versions" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest.latest_version(spark, str(tmp_path))


def test_review_routing_folds_values_once(spark):
    done = st.standardize(observe(spark, "size", [("10 inch", "manufacturer"), ("12 inch", "web"), ("", "web")]), spark.createDataFrame(RULES, RULES_SCHEMA))
    keep, review = st.route_to_review(done.where("status = 'ok'"))
    assert [tuple(r) for r in keep.select("confidence", "reason").collect()] == [(0.95, "Highest confidence source: manufacturer")] and review.count() == 0
    for side in (keep, review):
        assert "Python" not in side._jdf.queryExecution().optimizedPlan().toString()


def test_status_needs_no_fold_over_numbers(spark):
    done = st.standardize(observe(spark, "size", [("10 inch", "web"), ("", "web")]), spark.createDataFrame(RULES, RULES_SCHEMA))
    keys = done.where("status = 'ok'").select("product_key", "attribute")
    assert keys.count() == 1 and "aggregate(" not in keys._jdf.queryExecution().optimizedPlan().toString()


def test_forms_are_made_of_different_values(spark):
    rows = [("12 IN", "web")] * 3 + [("12.0 in", "web"), (None, "web"), ("&#34;a&#34;\u3000", "web"), ('"A"', "web"), ("", "web")]
    out = st.canonical_conflict(observe(spark, "size", rows))
    assert [tuple(r) for r in out.collect()] == [(1, "size", 8, 3, True)]
    assert "Aggregate [product_key#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", value#" in plan.split("Aggregate [")[-1].split("]")[0]


def test_canonical_values_are_not_dealt_out_by_label(spark):
    rows = spark.createDataFrame([(1, 2, "Size", "3", "a"), (1, 1, "Item size", "4", "b"), (1, 1, "?", "5", "b")], "product_key long, source_pos long, label string, value string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unified = st.unify_attributes(rows, spark.createDataFrame([("Item size", "size", 0.9)], "label string, canonical string, confidence double"))
        few, many = (st.gather_canonical_values(rows, unified, max_labels=n) for n in (100, 0))
        for out in (few, many):
            assert sorted(map(tuple, out.collect())) == [(1, "size", 1, "4", "b"), (1, "size", 2, "3", "a")]
        assert "hashpartitioning(label" not in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_extractions_are_dealt_out_by_product_alone(spark):
    out = values.extracted(spark, "/root/testdata/sf0.001", rows_per_task=600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sku" in plan and "hashpartitioning(product_key" not in plan
    assert out.rdd.getNumPartitions() >= 10


def test_filter_on_status_runs_the_fold_of_values_once(spark):
    """Whether there is any value is known before the fold; single values reach Python as empty lists, not as nulls."""
    observations = observe(spark, "a", [("deep blue", "web"), ("deep bluee", "web"), ("black", "web")])
    observations = observations.unionByName(observe(spark, "b", [("red", "web")])).unionByName(observe(spark, "c", [("", "web")]))
    done = st.standardize(observations, spark.createDataFrame(RULES, RULES_SCHEMA)).where("status = 'ok'")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.attribute: r.standard_value for r in done.collect()} == {"a": "deep blue", "b": "red"}
    lists = st.value_lists(observations).select("attribute", st.keep_dissimilar("vals").alias("k"))
    sent = lists._jdf.queryExecution().optimizedPlan().toString().split("positions(")[1]
    assert "ELSE []" in sent.splitlines()[0]
    assert {r.attribute: r.k and [x.value for x in r.k] for r in lists.collect()} == {"a": ["deep blue", "black"], "b": ["red"], "c": None}
