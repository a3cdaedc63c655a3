"""Extraction kept by content, and pages that a parser fails on."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract as ex
from lodestone.operators.markup import Page
from lodestone.plans import aggregate as ag
from lodestone.storage import written
from lodestone.streaming.ingest import ingest_batch, read_catalog, source_states

LONG = "<p>nothing of note in this paragraph</p>" * 5
GOOD, OTHER, NONE, BAD = f"{LONG}<p>Weight: 5 kg</p>", f"{LONG}<li>Colour: red</li>", LONG, f"{LONG}<p>boom: yes it does</p>"


def parse(html):
    if "boom" in html:
        raise ValueError("boom")
    return Page(html)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string")


def found(df):
    return {(r.page_id, r.label, r.value) for r in df.where("label is not null").collect()}


def contents(spark, store):
    return sorted(r.content_key for r in ex.stored(spark, store).where("label is null").collect())


def test_equal_pages_are_parsed_once(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(1, GOOD), (2, GOOD), (3, NONE), (4, None), (5, OTHER)]
    assert found(ex.extract_by_content(frame(spark, rows), store)) == {(1, "Weight", "5 kg"), (2, "Weight", "5 kg"), (5, "Colour", "red")}
    assert len(contents(spark, store)) == 3
    before = ex.stored(spark, store).count()

    def never(html):
        raise AssertionError("parsed again")

    again = ex.extract_by_content(frame(spark, [(9, GOOD), (8, NONE)]).withColumn("label", F.lit("x")), store, never)
    assert found(again) == {(9, "Weight", "5 kg")} and ex.stored(spark, store).count() == before
    more = ex.extract_by_content(frame(spark, [(1, GOOD), (7, f"{GOOD}<p>Depth: 1</p>")]), store)
    assert {x for x in found(more) if x[0] == 7} == {(7, "Weight", "5 kg"), (7, "Depth", "1")} and len(contents(spark, store)) == 4
    assert found(ex.extract_by_content(frame(spark, []), store)) == set()


def test_a_page_that_fails_fails_alone(spark, tmp_path):
    pages = frame(spark, [(1, GOOD), (2, BAD), (3, NONE), (4, "short"), (5, None)])
    want = {1: (None, "Weight", "5 kg", "fallback"), 2: ("extraction_failed", None, None, None), 3: (None, None, None, "fallback"), 4: ("empty_html", None, None, None), 5: ("empty_html", None, None, None)}
    for store in (None, str(tmp_path / "store")):
        got = {r.page_id: (r.error, r.label, r.value, r.extraction_method) for r in ex.extract_page(pages, store, parse).collect()}
        assert got == want


@pytest.fixture
def web(spark):
    pages = spark.createDataFrame([(1, "u1", GOOD), (2, "u2", BAD), (3, "u3", OTHER), (4, "u4", BAD)], "page_id long, url string, html string")
    results = spark.createDataFrame([("A", 1, "u1", True), ("B", 1, "u2", True), ("C", 1, "u4", True), ("C", 2, "u3", True)], "product_key string, result_rank long, url string, fetched boolean")
    synonyms = spark.createDataFrame([], "label string, canonical string, confidence double")
    rules = spark.createDataFrame([], "attribute string, type string, allowed array<string>, min double, max double, unit string, multi_value boolean")
    return ag.Web(results, pages, synonyms, rules, parse=parse)


def submitted(spark, rows):
    return spark.createDataFrame([(k, "html", f"s{k}", "p", f"SKU: {code}") for k, code in rows], "source_id long, source_type string, source_url string, project_id string, content string")


def test_a_bad_source_does_not_stop_its_batch(spark, web, tmp_path):
    folder = str(tmp_path / "ingest")
    ingest_batch(submitted(spark, [(1, "A"), (2, "B"), (3, "C"), (4, "none")]), 0, folder, web)
    assert {r.source_id: r.status for r in source_states(spark, folder).collect()} == {1: "completed", 2: "failed", 3: "completed", 4: "completed"}
    assert {r.product_code for r in read_catalog(spark, folder, 0).products.collect()} == {"A", "C"}
    mended = ag.Web(web.results, web.pages.withColumn("html", F.replace("html", F.lit("boom"), F.lit("Shape"))), web.synonyms, web.rules, parse=parse)
    ingest_batch(submitted(spark, [(2, "B"), (1, "A")]), 1, folder, mended)
    assert {r.source_id: r.status for r in source_states(spark, folder).collect()} == {1: "completed", 2: "completed", 3: "completed", 4: "completed"}
    assert {r.product_code for r in read_catalog(spark, folder, 1).products.collect()} == {"A", "B", "C"}


def test_reasons_of_products(spark, web):
    ids = spark.createDataFrame([("A", "A", "t"), ("B", "B", "t"), ("C", "C", "t"), ("D", "D", "t")], "product_key string, mpn string, title string")
    records = ag.aggregate_products(ids, web.results, web.pages, web.synonyms, web.rules, parse=parse)[0]
    assert {r.product_key: (r.status, r.reason) for r in records.collect()} == {"A": ("success", None), "B": ("failed", "extraction_failed"), "C": ("success", None), "D": ("failed", "no_sources")}


def broadcast_by(*frames):
    """First keys of the broadcast joins in the plans of frames: a join on any other key deals out both sides."""
    return {k for df in frames for k in re.findall(r"Broadcast\w*Join \[(\w+)", df._jdf.queryExecution().executedPlan().toString())}


#: Labels and attributes join tables that are counted before they are broadcast.
BOUNDED = {"label", "attribute"}


def stored_web(web):
    """The web as small files, which Spark would broadcast."""
    return replace(web, results=written(web.results), pages=written(web.pages), synonyms=written(web.synonyms), rules=written(web.rules))


def test_products_and_pages_are_not_broadcast(spark, web):
    web, seen = stored_web(web), []

    def cut(df):
        seen.append(df)
        return written(df)

    ids = written(spark.createDataFrame([("A", "A", "t"), ("D", "D", "t")], "product_key string, mpn string, title string"))
    records, done = ag.aggregate_products(ids, web.results, web.pages, web.synonyms, web.rules, cut, parse=parse)
    assert broadcast_by(*seen, records, done) <= BOUNDED
    assert {r.product_key: (r.n_attributes, r.sources_used) for r in records.collect()} == {"A": (1, 1), "D": (0, 0)}
    assert broadcast_by(records) <= BOUNDED


def test_submitted_sources_are_not_broadcast(spark, web):
    web, none = stored_web(web), ag.Catalog.empty(spark)
    rows = lambda *given: written(submitted(spark, given))
    one = lambda c: ag.Catalog(**{k: written(v) for k, v in vars(c).items()})
    before = one(ag.ingest_sources(rows((1, "A"), (2, "B"), (5, "A")), none, web))
    after = ag.ingest_sources(rows((1, "A"), (2, "B"), (3, "C"), (4, "none")), before, web)
    effects = [after.audit, after.priorities, after.sources]
    assert broadcast_by(*effects) <= BOUNDED and broadcast_by(after.products) <= BOUNDED
    assert {r.source_id: r.status for r in after.sources.collect()} == {1: "completed", 2: "failed", 3: "completed", 4: "completed", 5: "completed"}
    assert sorted(r.source_id for r in after.priorities.collect()) == [1, 2, 3, 4, 5]
    assert {(r.product_code, r.completeness_score) for r in after.products.collect()} == {("A", 5), ("C", 5)}
    assert sorted(r.product_id for r in after.audit.collect()) == ["A", "A", "B", "B", "C", "none"]
