"""One pass over the tags of a page: a stack of open elements gives each element's own text, inner elements included.

The tree is the one that tags alone make: a closing tag ends the nearest open element of its name and all that is open
inside it, or nothing if there is none; tags that were left out are not guessed. A page is read once for all strategies.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

# Tags whose text is searched for labels, the forms of labels and values, and bounds on their lengths.
BLOCK_TAGS = ("p", "li", "div", "span")
LABEL = r"[A-Za-z][A-Za-z\s]{2,50}"
VALUE = r"[^\n:]{1,200}"
LABEL_CHARS = 51
TABLE_LABEL, TABLE_VALUE, TERM = (2, 100), 500, 100
NO_LABELS = ("http", "www")
LINKED_DATA = "application/ld+json"
#: Elements without content. (Texts in template, rt and rp aren't part of what holds them, see ``_text``.)
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())

#: The strategies by number, and characters that one step of the pass holds.
FAILED, TABLES, TERMS, LABELS, META, LINKED = 0, 1, 2, 3, 4, 5
STEP_CHARS = 4_000_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|</(?P<close>[A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*>"""
    r"""|<(?P<open>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+(?=>)|[^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", re.S)
_SLASH_VALUE = re.compile(r"""=\s*[^\s"'=]*/\Z""")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style")}
_LABEL_BEFORE = re.compile(rf"(?:{LABEL})\Z")
_VALUE_AFTER = re.compile(rf":\s*({VALUE})")


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


class Page:
    """Elements in the order of their opening tags, each with the range of texts and the last element inside it."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.names: list[str] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.last: list[int] = []
        self.metas: list[dict[str, str]] = []
        self.linked: list[str] = []
        self._read(html)
        self.places: dict[str, list[int]] = defaultdict(list)
        for k, name in enumerate(self.names):
            self.places[name].append(k)

    def _read(self, html: str) -> None:
        stack: list[int] = []
        count: Counter = Counter()
        at, tags_end = 0, html.rfind(">") + 1  # behind it no tag can end, and a search would run to the end each time
        while m := _TAG.search(html, at, tags_end):
            self._text(html[at : m.start()], count)
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            if name := m["close"]:
                name = name.lower()
                while count[name]:
                    e = stack.pop()
                    self._close(e, count)
                    if self.names[e] == name:
                        break
            elif name := m["open"]:
                name, rest = name.lower(), m["rest"]
                empty = rest.endswith("/") and not _SLASH_VALUE.search(rest)
                if name == "meta":
                    self.metas.append(attributes(rest))
                if name in _RAW_END and not empty:
                    stop = _RAW_END[name].search(html, at)
                    raw = html[at : stop.start() if stop else len(html)]
                    if name == "script" and attributes(rest).get("type") == LINKED_DATA:
                        self.linked.append(raw)
                    at += len(raw)
                if name in VOID:
                    continue
                e = len(self.names)
                self.names.append(name)
                self.begin.append(len(self.texts))
                self.end.append(0)
                self.last.append(0)
                count[name] += 1
                if empty:
                    self._close(e, count)
                else:
                    stack.append(e)
        self._text(html[at:], count)
        for e in stack:
            self._close(e, count)

    def _text(self, raw: str, count: Counter) -> None:
        if not raw or count["template"] or count["rt"] or count["rp"]:
            return
        text = unescape(raw) if "&" in raw else raw
        if text.isspace() and not text.strip(" \t\n\r\f\v") and not (count["pre"] or count["textarea"]):
            text = "\n" if "\n" in text else " "
        self.texts.append(text)

    def _close(self, e: int, count: Counter) -> None:
        self.end[e], self.last[e] = len(self.texts), len(self.names)
        count[self.names[e]] -= 1

    def inside(self, e: int, *names: str) -> list[int]:
        """Elements of these names inside ``e``, in order."""
        out = []
        for name in names:
            places = self.places.get(name, [])
            out += places[bisect_left(places, e + 1) : bisect_left(places, self.last[e])]
        return sorted(out)

    def joined(self, e: int) -> str:
        """The text of an element, each text node stripped and nothing between nodes."""
        return "".join(t.strip() for t in self.texts[self.begin[e] : self.end[e]])


def table_pairs(page: Page) -> Iterator[tuple[str, str]]:
    """Rows with two cells, for each table in turn; cells of inner tables belong to their outer rows, too."""
    for table in page.places.get("table", []):
        for row in page.inside(table, "tr"):
            cells = page.inside(row, "td", "th")
            if len(cells) == 2:
                label, value = page.joined(cells[0]).rstrip(":"), page.joined(cells[1])
                if value and TABLE_LABEL[0] < len(label) < TABLE_LABEL[1] and len(value) < TABLE_VALUE:
                    yield label, value


def term_pairs(page: Page) -> Iterator[tuple[str, str]]:
    """Terms and descriptions of each definition list, as far as the shorter goes."""
    for e in page.places.get("dl", []):
        for dt, dd in zip(page.inside(e, "dt"), page.inside(e, "dd"), strict=False):
            label, value = page.joined(dt).rstrip(":"), page.joined(dd)
            if label and value and len(label) < TERM:
                yield label, value


def labelled(text: str, colons: list[int], begin: int, end: int) -> Iterator[tuple[str, str]]:
    """Labels before colons with their values in ``text[begin:end]``: what a search for label, colon and value finds from
    left to right. Only places with a colon are looked at; ``colons`` has all of ``text``."""
    for k in range(bisect_left(colons, begin), bisect_left(colons, end)):
        colon = colons[k]
        if colon < begin:
            continue
        before = _LABEL_BEFORE.search(text[max(begin, colon - LABEL_CHARS) : colon])
        after = before and _VALUE_AFTER.match(text, colon, end)
        if after:
            begin = after.end()
            label, value = before[0].strip(), after[1].strip()
            if label and value and not label.lower().startswith(NO_LABELS):
                yield label, value


def label_pairs(page: Page) -> Iterator[tuple[str, str]]:
    """Labelled values in the whole text of each block, in the order of opening tags, so that inner blocks come later."""
    starts = [0]
    for t in page.texts:
        starts.append(starts[-1] + len(t))
    text = "".join(page.texts)
    colons = [m.start() for m in re.finditer(":", text)]
    if colons:
        for e in sorted(k for t in BLOCK_TAGS for k in page.places.get(t, [])):
            yield from labelled(text, colons, starts[page.begin[e]], starts[page.end[e]])


def meta_pairs(page: Page) -> Iterator[tuple[str, str]]:
    """Property and content of meta tags with a product property."""
    for a in page.metas:
        if a.get("content") and "product" in a.get("property", "").lower():
            yield a["property"], a["content"]


def linked_texts(page: Page) -> Iterator[tuple[str, str]]:
    """Texts of linked data, as values without a label."""
    return (("", raw) for raw in page.linked)


STRATEGIES = {TABLES: table_pairs, TERMS: term_pairs, LABELS: label_pairs, META: meta_pairs, LINKED: linked_texts}


def page_pairs(pages: DataFrame, strategies: Iterable[int] = tuple(STRATEGIES), *, mark: bool = False, parse: Callable[[str], Page] = Page) -> DataFrame:
    """``page_id, strategy, ord, label, value`` of the wanted strategies, raw, in one pass over ``pages(page_id, html)``.

    A null page has no rows; ``ord`` counts the pairs of a strategy in a page from 0. The same pair comes once, with its last
    place, so that nested blocks don't repeat their pairs. Rows with equal ids count each. A page that ``parse`` fails on
    doesn't fail the job; with ``mark`` each page has a row of strategy 0 without a label, its value the error or null.
    """
    schema = T.StructType([
        T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("strategy", T.IntegerType()), T.StructField("ord", T.IntegerType()),
        T.StructField("label", T.StringType()), T.StructField("value", T.StringType()),
    ])
    wanted = sorted(set(strategies))

    def run(batches):
        arrow = to_arrow_schema(schema)
        rows, size = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for page_id, html in ((i.as_py(), h.as_py()) for i, h in zip(batch.column(0), batch.column(1), strict=True)):
                found, error = [], None
                try:
                    page = parse(html)
                    for s in wanted:
                        last = {pair: k for k, pair in enumerate(STRATEGIES[s](page))}
                        found += [(page_id, s, k, label, value) for (label, value), k in last.items()]
                except Exception as e:  # noqa: BLE001  whatever is wrong with a page concerns that page alone
                    found, error = [], f"{type(e).__name__}: {e}"
                for r in [*found, (page_id, FAILED, 0, None, error)] if mark else found:
                    rows.append(r)
                    size += len(r[3] or "") + len(r[4] or "")
                    if size >= STEP_CHARS or len(rows) >= 10_000:
                        yield whole()
                        rows, size = [], 0
        if rows:
            yield whole()

    return pages.where("html is not null").select("page_id", "html").mapInArrow(run, schema)
