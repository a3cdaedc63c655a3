"""The pass over tags against a tree of Python's parser, on pages of random markup."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodestone.fixtures import frame
from lodestone.operators import extract as ex
from lodestone.operators import markup as mk

HIDDEN = {"script", "style", "template", "rt", "rp"}


class Node:
    def __init__(self, name):
        self.name, self.children = name, []


class Tree(HTMLParser):
    """Elements as tags alone nest them."""

    def __init__(self, html):
        super().__init__()
        self.root = Node("")
        self.stack, self.joins = [self.root], False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.joins = False
        node = Node(tag)
        self.stack[-1].children.append(node)
        if tag not in mk.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.joins = False
        self.stack[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        self.joins = False
        if any(n.name == tag for n in self.stack):
            while self.stack.pop().name != tag:
                pass

    def handle_comment(self, data):
        self.joins = False

    def handle_data(self, data):
        if self.joins:
            text, inside = self.stack[-1].children.pop()
            self.stack[-1].children.append((text + data, inside))
        else:
            self.stack[-1].children.append((data, {n.name for n in self.stack}))
        self.joins = True


def find(node, names):
    for c in node.children:
        if isinstance(c, Node):
            if c.name in names:
                yield c
            yield from find(c, names)


def strings(node):
    for c in node.children:
        if isinstance(c, Node):
            yield from strings(c)
        elif not c[1] & HIDDEN:
            yield c[0] if c[1] & {"pre", "textarea"} or c[0].strip(" \t\n\r\f\v") else "\n" if "\n" in c[0] else " "


def stripped(node):
    return "".join(s.strip() for s in strings(node))


def brute(html):
    """Pairs by strategy, in order, by the plain definitions."""
    root, out = Tree(html).root, {1: [], 2: [], 3: []}
    for table in find(root, ("table",)):
        for row in find(table, ("tr",)):
            cells = list(find(row, ("td", "th")))
            if len(cells) == 2:
                k, v = stripped(cells[0]).rstrip(":"), stripped(cells[1])
                if k and v and 2 < len(k) < 100 and len(v) < 500:
                    out[1].append((k, v))
    for dl in find(root, ("dl",)):
        for dt, dd in zip(find(dl, ("dt",)), find(dl, ("dd",)), strict=False):
            k, v = stripped(dt).rstrip(":"), stripped(dd)
            if k and v and len(k) < 100:
                out[2].append((k, v))
    for block in find(root, ("p", "li", "div", "span")):
        for k, v in re.findall(r"([A-Za-z][A-Za-z\s]{2,50}):\s*([^\n:]{1,200})", "".join(strings(block))):
            k, v = k.strip(), v.strip()
            if k and v and not k.lower().startswith(("http", "www")):
                out[3].append((k, v))
    return out


TAGS = ("p", "li", "div", "span", "b", "table", "tr", "td", "th", "dl", "dt", "dd", "pre", "ul")
TEXTS = ("Weight: 5 kg", "Colour: red", "Size:", "  ", "\n", " \n ", "a", "www Site: x", "Net  weight : 3", "x: y: z", "Deep\nlabel: v\nw", "5 &lt; 6", "&nbsp;", "Term", "one", "a much longer run of words that goes on and on and on before its colon: here", "é: ü", "http://a.b", ": :", "w" * 300)


def markup(rng, n):
    out, open_tags = [], []
    for _ in range(n):
        roll = rng.random()
        if roll < 0.3:
            out.append(rng.choice(TEXTS))
        elif roll < 0.35:
            a, b = rng.choice(TEXTS), rng.choice(TEXTS)
            out.append(rng.choice((f"<table><tr><td>{a}</td><td><b>{b}</b></td></tr></table>", f"<tr><th>{a}</th><td>{b}</td></tr>", f"<table><tr><td>{a}</td><td>{b}", f"<dl><dt>{a}</dt><dd>{b}</dd></dl>", f"<dt>{a}</dt><dd>{b}</dd>")))
        elif roll < 0.65:
            tag = rng.choice(TAGS)
            open_tags.append(tag)
            out.append(f"<{tag.upper() if rng.random() < 0.1 else tag}{rng.choice(('', '', ' class=a', ' title=\"a > b\"', ' x=\"1\" y'))}>")
        elif roll < 0.9 and open_tags:
            out.append(f"</{open_tags.pop()}>")
        elif roll < 0.94:
            out.append(f"</{rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(("<br>", "<br/>", "<!-- <p>Gone: 1</p> -->", "<script>var a = '<p>Not: this</p>';</script>", "<hr>", "<span/>", "<style>p:hover{}</style>", "<template><p>Not: this</p></template>", "<template>")))
    return "".join(out)


@pytest.fixture(scope="module")
def random_pages():
    rng = random.Random(5)
    return [markup(rng, rng.randint(3, 90)) for _ in range(600)]


def test_pass_equals_a_tree(spark, random_pages):
    rows = ex.all_pairs(spark.createDataFrame(list(enumerate(random_pages)), "page_id long, html string")).orderBy("page_id", "strategy", "ord").collect()
    got = {}
    for r in rows:
        got.setdefault((r.page_id, r.strategy), []).append((r.label, r.value))
    pairs = {1: 0, 2: 0, 3: 0}
    for i, html in enumerate(random_pages):
        for s, want in brute(html).items():
            last = {p: k for k, p in enumerate(want)}
            assert got.get((i, s), []) == sorted(last, key=last.get), (s, html)
            pairs[s] += len(last)
    assert min(pairs.values()) > 50 and pairs[3] > 1000, pairs


def test_merged_pairs_equal_a_dictionary(spark, random_pages):
    rows = ex.fallback_extraction(spark.createDataFrame(list(enumerate(random_pages)), "page_id long, html string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, {})[r.label] = r.value
    for i, html in enumerate(random_pages):
        assert got.get(i, {}) == {k: v for s in (1, 2, 3) for k, v in brute(html)[s]}


def test_inner_blocks_come_later(spark):
    html = "<div><p>Weight: 5 kg</p><p>Colour: red</p></div>"
    assert {r.label: r.value for r in ex.fallback_extraction(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()} == {"Weight": "5 kg", "Colour": "red"}


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<p>Weight: 1", "<!-- Weight: 1 <p>a</p>", "<script>Weight: 1", "</p></p>", "<p title='it>Size: 1</p>", "<a" * 100_000, "<p>" * 3000 + "Size: 1", "<div>" + "Size: 1\n" * 20_000])
def test_hard_pages(spark, html):
    frame = spark.createDataFrame([(1, html), (1, html)], "page_id long, html string").withColumn("label", F.lit("x")).withColumn("strategy", F.lit("y"))
    rows = ex.all_pairs(frame).collect()
    assert {(r.label, r.value) for r in rows} <= {("Weight", "1"), ("Size", "1")}
    assert ("Size", "1") in {(r.label, r.value) for r in rows} or html is None or "Size" not in html or "title" in html


def test_plan_has_one_pass(spark):
    plan = ex.fallback_extraction(spark.createDataFrame([(1, "x")], "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("view", ["fx_spec_pages", "fx_nested_pages", "fx_source_pages"])
def test_pages_made_from_one_file_are_parsed_by_several_tasks(spark, view):
    rows = ex.text_label_pairs(frame(spark, "/root/testdata/sf0.001", view)).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 1
