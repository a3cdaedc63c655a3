"""Registered catalog queries against their SQL, snapshot updates, extraction, plans, and the stream."""

import json
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.fixtures import TABLES, frame
from lodestone.operators import catalog as ct
from lodestone.operators import extract as ex
from lodestone.operators import golden as gd
from lodestone.operators import standardize as st
from lodestone.plans import aggregate as ag
from lodestone.plans import registry
from lodestone.plans.intake import web
from lodestone.sources import files
from lodestone.storage import shared_path
from lodestone.streaming.ingest import ingest_batch, ingest_stream, latest_version, read_catalog, source_states

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(row):
    return tuple(round(float(v), 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]}) q").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert Counter(map(norm, rows)) == Counter(map(norm, want))


def pages(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_extraction_rules(spark):
    html = """<body><div>x</div><table><tr><td>Weight:</td><td>5 <b>kg</b></td></tr><tr><td>ab</td><td>short key</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>
      <dl><dt>a</dt><dt>b</dt><dd>x</dd></dl><p>Color: red &amp; blue</p><p>http: no</p><meta content="9" property="product:sale_price">
      <script type="application/ld+json">{"@type":["Product","X"],"name":"N","n":3,"o":{"a":1},"l":[1],"f":true,"z":null}</script>
      <script type="application/ld+json">not json Product</script></body>"""
    got = {r.label: r.value for r in ex.fallback_extraction(pages(spark, html)).collect()}
    assert got == {"Weight": "5kg", "a": "x", "Color": "red & blue", "Sale Price": "9", "Name": "N", "N": "3", "F": "true"}
    assert ex.html_definition_pairs(pages(spark, html)).count() == 1
    assert ex.extract_page(pages(spark, "short")).first().error == "empty_html"
    assert ex.extract_page(pages(spark, "<p>nothing here</p>" * 20)).first().label is None


def test_named_values_come_from_whole_pages(spark):
    far = "<p>filler</p>" * 2_000  # 26,000 characters
    html = f"<li>Size: 5</li>{far}<li>Size: 5 by 7</li><table><tr><td>Brand</td><td>Acme</td></tr></table>{far}<li>Colour: red</li>"
    rows = pages(spark, html).unionByName(spark.createDataFrame([(2, f"{far}<li>Brand: Late</li><li>Shape: round</li>"), (3, f"{far}<li>Shape: flat</li>"), (4, None)], "page_id long, html string"))
    wanted = spark.createDataFrame([(f"A{i}",) for i in range(60)] + [("Size",), ("Brand",), ("Brand",)], "label string")
    found = [(1, "Size", "5 by 7", "named"), (1, "Brand", "Acme", "named"), (2, "Brand", "Late", "named"), (3, "Shape", "flat", "fallback")]
    assert Counter(tuple(r) for r in ex.extract_named(rows, wanted).collect()) == Counter(found)
    assert Counter(tuple(r) for r in ex.extract_named(rows, wanted, 1).collect()) == Counter(found)


def test_labels_are_discovered_in_whole_pages(spark):
    far = "<p>filler</p>" * 2_000  # 26,000 characters
    late = f"{far}<li>Size: 5</li><table><tr><td>Brand</td><td>Acme</td></tr></table>{far}<dl><dt>Shape</dt><dd>round</dd></dl>"
    rows = pages(spark, late).unionByName(spark.createDataFrame([(2, f"<li>Size: 6</li>{far}<li>Colour: red</li>"), (2, "<li>Size: 6</li>"), (3, None)], "page_id long, html string"))
    assert {tuple(r) for r in ex.discover_attributes(rows).collect()} == {("Size", 2), ("Brand", 1), ("Shape", 1), ("Colour", 1)}


def test_later_strategy_wins(spark):
    html = "<table><tr><td>Brand</td><td>one</td></tr></table><li>Brand: two</li>"
    assert [(r.label, r.value) for r in ex.fallback_extraction(pages(spark, html)).collect()] == [("Brand", "two")]


class Pairs(HTMLParser):
    """Pairs of table rows, definition lists, labelled list items, meta tags and linked data, by a parser of tags."""

    def __init__(self, html):
        super().__init__()
        self.rows, self.cell, self.data, self.kind, self.pairs = [], None, None, None, set()
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th", "dt", "dd", "li"):
            self.cell = []
        elif tag == "table" and self.rows:
            self.rows[-1].append("")
        elif tag == "meta" and "product" in attrs.get("property", ""):
            self.pairs.add((attrs["property"].split(":")[-1].replace("_", " ").title(), attrs["content"]))
        elif tag == "script":
            self.kind, self.data = attrs.get("type"), ""

    def handle_data(self, data):
        if self.data is not None:
            self.data += data
        elif self.cell is not None:
            self.cell.append(data.strip())

    def handle_endtag(self, tag):
        text = "".join(self.cell or [])
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(text)
        elif tag == "dt":
            self.term = text
        elif tag == "dd":
            self.pairs.add((self.term.rstrip(":"), text))
        elif tag == "li" and ":" in text:
            self.pairs.add(tuple(x.strip() for x in text.split(":", 1)))
        elif tag == "tr" and self.rows:
            row = self.rows.pop()
            if len(row) == 2 and all(row):
                self.pairs.add((row[0].rstrip(":"), row[1]))
        elif tag == "script":
            if self.kind == "application/ld+json":
                self.pairs |= {(k.title(), v) for k, v in json.loads(self.data).items() if k[0] != "@"}
            self.data = None
        if tag in ("td", "th", "dt", "dd", "li"):
            self.cell = None


def test_every_page_is_extracted_whole(spark, tmp_path):
    table = "<table><tr><td>Weight</td><td>{} kg</td></tr></table>"
    html = [
        "<html><body>" + "<p>nothing to find</p>" * 10 + "</body></html>",
        f"<body><!-- {table.format(1)} <li>Gone: one</li> --><script>var t = '{table.format(2)}<li>Other: two</li>';</script>" + "<p>text</p>" * 20 + table.format(3) + "</body>",
        f"<body><table><tr><td>{table.format(4)}</td></tr><tr><th>Outer:</th><td>five</td></tr></table><dl><dt>Term:</dt><dd>six <b>7</b></dd></dl>" + "<p>text</p>" * 20,
        '<meta property="product:list_price" content="8"><!-- <meta property="product:old_price" content="9"><script type="application/ld+json">{"@type":"Product","gone":"x"}</script> -->'
        '<script>var a = "<!-- no comment";</script><script type="application/ld+json">{"@type":"Product","name":"Nine"}</script>' + "<p>text</p>" * 20 + "<ul><li>Colour: red</li></ul>",
        "<p>short</p>",
    ]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/part.parquet").where("p_partkey = 1").write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.QUERIES["x8_extract_page_every_page"](spark, str(tmp_path)).collect()
    for i, h in enumerate(html):
        mine = [r for r in rows if r.page_id == -1 - i]
        assert {r.error for r in mine} == {"empty_html" if i == 4 else None}
        assert {(r.label, r.value) for r in mine} == (Pairs(h).pairs or {(None, None)}), i
    assert {r.label for r in rows if r.page_id == 1} == {"Size", "Brand", "Material Type", "Retail Price", "Name", "Sku"}
    seen = registry.QUERIES["x8_extract_page_every_page"](spark, SF).where("page_id < 0")
    assert seen.select("page_id").distinct().count() == frame(spark, SF, "pages").count()


def test_main_text(spark):
    text = pages(spark, "<html><head><title>t</title></head><body><nav>n</nav><main> a<b>b</b><script>x</script> &lt;c </main><footer>f</footer></body>").select(ex.html_main_text(F.col("html"))).first()[0]
    assert text == "a b <c"


def test_golden_record(spark):
    products = spark.createDataFrame([(1, "s", "b"), (2, "s", "b"), (3, "s", None), (4, "s", "b"), (5, None, None)], "product_key long, sku string, brand string")
    specs = spark.createDataFrame([(k, f"a{i}") for k, n in ((1, 4), (2, 5), (3, 5)) for i in range(n)], "product_key long, attribute string")
    got = {r.product_key: (r.ready_for_publish, r.confidence, r.error) for r in gd.build_golden_record(products, specs).collect()}
    assert got == {1: (True, 0.5, None), 2: (True, 0.7, None), 3: (False, 0.7, None), 4: (False, None, "no_standardized_data"), 5: (False, None, "missing_identifiers")}


def test_updates_are_idempotent(spark):
    current = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    incoming = spark.createDataFrame([("b", 3, None), ("c", 4, "y")], "k string, v int, w string")
    once = ct.sync_rows(current, incoming, "k")
    assert sorted(map(tuple, once.collect())) == [("a", 1, None), ("b", 3, None), ("c", 4, "y")]
    assert sorted(map(tuple, ct.sync_rows(once, incoming, "k").collect())) == sorted(map(tuple, once.collect()))
    assert ct.publish(frame(spark, SF, "fx_products"), spark.createDataFrame([(10**9,)], "product_id long"), F.current_timestamp())[1].first().stage == "not_found"


def test_intake_headers_and_missing_files(spark):
    rows = spark.createDataFrame([("", "m1", None, " "), (None, " ", "p3", "t"), ("", "", "", "")], "`SKU ` string, MPN string, `Part Number` string, `Product Title` string")
    assert sorted((r.mpn, r.title or "") for r in files.normalize_intake(rows).collect()) == [("m1", ""), ("p3", "t")]
    assert files.read_catalog_file(spark, "/tmp/no-such-folder-here").count() == 0


def test_csv_export_quotes(spark):
    path = shared_path(spark, "export")
    products = spark.createDataFrame([("a", 'say "x", y', None, 5, 1), ("b", "n", "z", 5, None)], "product_code string, product_name string, brand_name string, completeness_score int, published_at int")
    files.export_catalog_csv(products, path)
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(path).collect()] == [("a", None, 'say "x", y', "5%")]
    assert spark.read.option("header", True).csv(path).columns == ["SKU", "Brand", "Name", "Completeness"]
    files.export_catalog_csv(products.limit(0), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["SKU,Brand,Name"]


def test_stream_applies_a_batch_and_a_source_once(spark):
    submissions, folder = shared_path(spark, "in"), shared_path(spark, "out")
    rows = frame(spark, SF, "fx_kv_sources").limit(12)
    rows.coalesce(1).write.parquet(submissions)
    known = web(spark, SF)
    first = ingest_stream(spark, submissions, folder, known).count()
    rows.coalesce(1).write.mode("append").parquet(submissions)
    assert ingest_stream(spark, submissions, folder, known).count() == first == 12
    version = latest_version(spark, folder)
    ingest_batch(rows, version, folder, known)
    after = read_catalog(spark, folder, latest_version(spark, folder))
    assert after.priorities.count() == 12 and after.audit.count() == 12 and after.sources.where("status = 'completed'").count() == 12
    # A later source changes a product; one whose batch doesn't end stays in processing.
    more = rows.limit(1).withColumn("source_id", F.lit(900001).cast("long"))
    ingest_batch(more, version + 1, folder, known)
    assert read_catalog(spark, folder, version + 1).products.count() == 12
    broken = ag.Web(known.results.drop("url"), known.pages, known.synonyms, known.rules)
    with pytest.raises(Exception):
        ingest_batch(rows.limit(1).withColumn("source_id", F.lit(900002).cast("long")), version + 2, folder, broken)
    states = {r.source_id: r.status for r in source_states(spark, folder).collect()}
    assert states.pop(900002) == "processing" and set(states.values()) == {"completed"} and len(states) == 13


def test_ingest_sources_whose_aggregation_fails(spark):
    known = web(spark, SF)
    schema = "source_id long, source_type string, source_url string, project_id string, content string"
    rows = spark.createDataFrame(
        [
            (1, "html", "u1", "p", "SKU: P-1\nbrand: Acme"),
            (2, "pdf", None, None, "SKU: no-such-product\nbrand: Acme"),
            (3, "html", "u3", "p", "no separator"),
            (4, "html", "u4", "p", None),
            (5, "html", "u5", "p", "SKU: P-1\nproduct_name: Late"),
        ],
        schema,
    )
    after = ag.ingest_sources(rows, ag.Catalog.empty(spark), known)
    assert [(r.product_code, r.product_name, r.completeness_score) for r in after.products.collect()] == [("P-1", "Late", 30)]
    lengths = {r.source_id: r.content and len(r.content) for r in rows.collect()}
    assert {r.source_id: r.raw_length for r in after.sources.where("status = 'completed'").collect()} == lengths
    assert sorted(r.product_id for r in after.audit.collect()) == ["P-1", "P-1", "no-such-product", "unknown", "unknown"]
    assert after.priorities.count() == 5
    again = ag.ingest_sources(rows, after, known)
    assert again.audit.count() == 5 and again.sources.count() == 5


def test_lists_come_newest_first(spark):
    for name, by, key in (("r1_list_sources", "uploaded_at", "source_id"), ("r15_list_rules", "created_at", "rule_id"), ("r24_list_projects", "created_at", "id")):
        rows = [(r[by], r[key]) for r in registry.QUERIES[name](spark, SF).collect()]
        assert len({t for t, _ in rows}) > 1 and rows == sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True), name
    rules = spark.createDataFrame([("r9", "a", True, "2024-01-01"), ("r1", "a", True, "2024-02-01"), ("r2", "a", False, "2024-03-01")], "rule_id string, attribute string, active boolean, created_at string")
    assert [r.rule_id for r in st.active_rules(rules).collect()] == ["r1"]


def test_evidence_of_attributes(spark):
    master = spark.createDataFrame([("p", "size", "m"), ("p", "type", "t")], "product_code string, attribute string, value string")
    found = spark.createDataFrame(
        [("p", 12345678901, 0.9, {"size": "2", "other": "x"}), ("p", 2, 0.4, {"size": "1"})], "sku string, source_id long, confidence double, attributes map<string,string>"
    )
    rows = {r.attribute: r for r in ct.attribute_evidence(master, found).collect()}
    assert [tuple(e) for e in rows["size"].evidence] == [("1", 0.4, "2"), ("2", 0.9, "12345678")] and rows["size"].conflict
    assert [tuple(e) for e in rows["type"].evidence] == [("t", 1.0, "Truth Engine")] and not rows["type"].conflict


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    one = plan(ct.get_by_key(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name"), "p_partkey", 17))
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,17)]" in one and "p_retailprice" not in one
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["r18_audit_latest"](spark, SF))
    for name in registry.QUERIES:
        if name[:2] in ("c1", "c6", "d3", "d7", "r4", "r5", "x7"):
            text = plan(registry.QUERIES[name](spark, SF))
            scored = name[:2] in ("d3", "d7")  # the exact ratio of similar values
            assert ("Python" in text.replace("ArrowEvalPython", "" if scored else "Python")) is False and "CartesianProduct" not in text, name
