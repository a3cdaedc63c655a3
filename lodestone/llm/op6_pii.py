"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for other spellings."""

from __future__ import annotations

import bisect
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SLICE_CHARS, map_slices, table

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"(?i)[\[(] ?(at|dot) ?[\])]")
_LABEL = re.compile(r"(?i)[a-z0-9-]+")
_TOP = re.compile(r"(?i)[a-z]{2,6}")
#: No address is longer (fixed value: 64 for the local part, the sign, 255 for the domain).
MOST_ADDRESS = 320
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
_LINE = re.compile(r"[^\n]+")

#: Small labelled table of the random field: [kind: ...] marks what to find; the rest is to be left alone.
LABELLED = (
    "call me at [phone: (555) 123-4567] tomorrow", "my number is [phone: 555-867-5309] thanks", "tel [phone: 030 1234 5678] office",
    "phone: [phone: 0049 30 1234567] or write", "fax [phone: 212.555.0187] please", "reach us on [phone: 1-800-555-0199] today",
    "mobile [phone: 07700 900 123] evenings", "ring [phone: (020) 7946 0958] now", "[phone: 555 010 7788] is his phone", "llame al [phone: 91 123 45 67] hoy",
    "mail [email: jane (at) example (dot) com] for it", "write to [email: bob [at] mail [dot] org] soon", "[email: info at site dot net] answers",
    "send it to [email: anna.k (at) web (dot) de] please", "contact [email: x_y [at] host [dot] co] first", "schreib an [email: max at firma dot de] bitte",
    "pay with [card: 4111/1111/1111/1111] today", "card [card: 5500.0000.0000.0004] expires soon", "visa [card: 4012/8888/8888/1881] thanks",
    "my card [card: 3400.0000.0000.009] is lost", "carte [card: 6011/0000/0000/0004] ici", "charge [card: 4242.4242.4242.4242] again",
    "host [ip: 10.0.0.1:8080] is down", "ping [ip: 192.168.1.1] now", "server [ip: 172.16.254.3] answered", "from [ip: 8.8.8.8] came a reply",
    "write [email: a.b@example.com] now", "mail [email: team@mail.example.org] today", "dial [phone: +1 (555) 010-9999] now", "use [card: 4111 1111 1111 1111] here",
    "in 2019 we sold 1200 units at 15.99 each", "version 1.2.3 of the tool came out on 2024-01-15", "chapter 12 begins on page 345",
    "the order 84512 weighs 12.5 kg and costs 1,200.50", "at ten dot com firms were many", "see figure 3.1 and table 4", "he met her at the dot on the map",
    "token = 9b0b3c6a43eb78aa99 in the file", "it was 25 degrees on 12/05/2020 at 10:30", "room 101 at level 7", "isbn 978 3 16 is short",
    "the of and that was in here with them", "el que de la una con para", "der die und zu ein mit", "le de les pour dans une", "they were all at home on that day",
    "score 3-2 after 90 minutes", "100 200 300 are numbers", "from 1990 to 2005 it grew by 40%", "look at (a) and (b) in part 2", "rows [1] and [2] are equal",
)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def fits(kind: str, text: str) -> bool:
    """Whether the digits and parts of a find are those of its kind."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)[:4]
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else spelled_address(text)


def spelled_address(text: str) -> bool:
    """Whether a text is an address with its sign, or one with "at" and "dot" as words, bare or in brackets."""
    if len(text) > MOST_ADDRESS:
        return False
    local, sign, domain = text.partition("@")
    if sign:
        return bool(local and domain) and not any(map(str.isspace, text))
    words = _MARK.sub(r" \1 ", text).split()
    if len(words) < 5 or len(words) % 2 == 0 or not any(map(str.isalnum, words[0])):
        return False
    marks, labels = [w.lower() for w in words[1::2]], words[2::2]
    return marks == ["at"] + ["dot"] * (len(marks) - 1) and all(map(_LABEL.fullmatch, labels)) and bool(_TOP.fullmatch(labels[-1]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds of the patterns, leftmost and without overlap for each kind, in order of kind and start.

    Time is linear in the text: an address grows to the left from its @, and numbers are entered at their first digit.
    """
    out = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind != "phone" or "+" in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return out


def shape(word: str) -> str:
    """Letters to x or X, digits to d, with runs of letters cut to one and of digits to their length up to 6; without end marks."""
    word = word.rstrip(".,;:!?") or word
    if word.isalpha():
        low = word.lower()
        return low if low in ("at", "dot") else "Xx" if word[0].isupper() else "x"
    if word.lower() in ("(at)", "[at]", "(dot)", "[dot]"):
        return word.lower()
    out = re.sub(r"[^\W\d_]+", lambda m: "x", word)
    return re.sub(r"[0-9]+", lambda m: "d" * min(6, len(m[0])), out)[:40]


def features(s: str) -> list[str]:
    n = s.count("d")
    out = [f"s={s}", f"n={min(n, 12)}", f"@={'@' in s}", f"first={s[0]}", f"last={s[-1]}", f"seps={''.join(sorted({c for c in s if c not in 'dx'}))[:6]}"]
    return [*out, "plain"] if s in ("x", "Xx") else out


@dataclass
class RandomField:
    """Weights of the features of a word and of its neighbours for each label (0: none), and of label changes."""

    names: dict[str, int] = field(default_factory=dict)
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, 5)))
    before: np.ndarray = field(default_factory=lambda: np.zeros((0, 5)))
    after: np.ndarray = field(default_factory=lambda: np.zeros((0, 5)))
    change: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))

    def emissions(self, s: str) -> np.ndarray:
        rows = [self.names[f] for f in features(s) if f in self.names]
        return np.stack([w[rows].sum(axis=0) for w in (self.own, self.before, self.after)])


def marked(line: str) -> tuple[list[str], list[int]]:
    """Words and labels of a line of the labelled table."""
    words, labels = [], []
    for kind, inside, outside in re.findall(r"\[(email|ip|card|phone): ((?:[^\[\]]|\[(?:at|dot)\])*)\]|(\S+)", line):
        part = inside.split() if kind else [outside]
        words += part
        labels += [KINDS.index(kind) + 1 if kind else 0] * len(part)
    return words, labels


def train(labelled: tuple[str, ...] = LABELLED, steps: int = 250, rate: float = 0.08, ridge: float = 0.02) -> RandomField:
    """Maximise the likelihood of the labelled lines by Adam on exact gradients (forward-backward over all lines at once)."""
    data = [marked(x) for x in labelled]
    n, most, k = len(data), max(len(w) for w, _ in data), len(KINDS) + 1
    shapes = sorted({shape(w) for ws, _ in data for w in ws})
    names = {f: i for i, f in enumerate(sorted({f for s in shapes for f in features(s)}))}
    has = np.zeros((len(shapes) + 1, len(names)))
    for i, s in enumerate(shapes):
        has[i, [names[f] for f in features(s)]] = 1
    ids = np.full((n, most + 2), len(shapes))
    y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (ws, ls) in enumerate(data):
        ids[i, 1 : len(ws) + 1] = [shapes.index(shape(w)) for w in ws]
        y[i, : len(ws)], mask[i, : len(ws)] = ls, True
    weights = [np.zeros((len(names), k)) for _ in range(3)] + [np.zeros((k, k))]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    truth = np.eye(k)[y] * mask[:, :, None]
    pairs = np.einsum("ntk,ntl->kl", truth[:, :-1], truth[:, 1:])
    add = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    around = (ids[:, 1:-1], ids[:, :-2], ids[:, 2:])
    for step in range(1, steps + 1):
        change = weights[3]
        e = sum((has @ w)[i] for w, i in zip(weights, around))
        alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
        alpha[:, 0] = e[:, 0]
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], e[:, t] + add(alpha[:, t - 1, :, None] + change, 1), alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], add(change + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = add(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        both = alpha[:, :-1, :, None] + change + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        residual = truth - p
        grads = []
        for i in around:
            g = np.zeros((len(shapes) + 1, k))
            np.add.at(g, i, residual)
            grads.append(has.T @ g)
        grads.append(pairs - expected)
        for j, (w, g) in enumerate(zip(weights, grads)):
            g = g - ridge * w
            m1[j], m2[j] = 0.9 * m1[j] + 0.1 * g, 0.999 * m2[j] + 0.001 * g * g
            w += rate * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-8)
    return RandomField(names, *weights)


def viterbi_alone(e: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best labels of one long line, without numpy's cost for each word."""
    into = [[float(x) for x in column] for column in change.T]
    rows = e.tolist()
    value, came = rows[0], []
    for row in rows[1:]:
        reach = [[*map(operator.add, value, column)] for column in into]
        tops = [*map(max, reach)]
        came.append(bytes(map(list.index, reach, tops)))
        value = [*map(operator.add, tops, row)]
    path = np.zeros(len(rows), np.int8)
    state = path[-1] = value.index(max(value))
    for t in range(len(came) - 1, -1, -1):
        state = path[t] = came[t][state]
    return path


def viterbi(e: list[np.ndarray], change: np.ndarray, alone: int = 2000) -> list[np.ndarray]:
    """Best labels of each line; lines of up to ``alone`` words advance together in batches, longer ones go alone."""
    short = [i for i, x in enumerate(e) if len(x) <= alone]
    out: list = [None if len(x) <= alone else viterbi_alone(x, change) for x in e]
    for i, path in zip(short, together([e[i] for i in short], change) if short else [], strict=True):
        out[i] = path
    return out


def together(e: list[np.ndarray], change: np.ndarray) -> list[np.ndarray]:
    order = sorted(range(len(e)), key=lambda i: -len(e[i]))
    lengths = np.array([len(e[i]) for i in order])
    flat = np.concatenate([e[i] for i in order])
    first = np.append(0, np.cumsum(lengths)[:-1])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    came = np.zeros(flat.shape, np.int8)
    value = flat[first]
    for t in range(1, lengths[0]):
        a = active[t]
        reach = value[:a, :, None] + change
        came[first[:a] + t] = reach.argmax(axis=1)
        value[:a] = reach.max(axis=1) + flat[first[:a] + t]
    state = value.argmax(axis=1)
    path = np.zeros(len(flat), np.int8)
    for t in range(lengths[0] - 1, -1, -1):
        a = active[t]
        path[first[:a] + t] = state[:a]
        state[:a] = came[first[:a] + t, state[:a]] if t else state[:a]
    out: list = [None] * len(e)
    for i, at, n in zip(order, first, lengths, strict=True):
        out[i] = path[at : at + n]
    return out


class Finder:
    """Labels the words of every line of a batch; the shapes of words come from a cache of bounded size."""

    def __init__(self, model: RandomField, cache: int = 200_000):
        self.model, self.cache = model, cache
        #: The changes into and out of a label are worth at most this over those without a label in its place.
        c = model.change
        self.slack = max(0.0, float((c[:, 1:, None] + c[None, 1:, :] - c[:, :1, None] - c[None, :1, :]).max()), float((c[:, 1:] - c[:, :1]).max()), float((c[1:] - c[:1]).max()))
        self.shapes: dict[str, int] = {}
        self.table = np.zeros((1, 3, len(KINDS) + 1))
        self.words: dict[str, int] = {}

    def shape_id(self, word: str) -> int:
        s = shape(word)
        k = self.shapes.get(s)
        if k is None:
            k = self.shapes[s] = len(self.shapes) + 1
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.emissions(s)
        if len(word) <= 64:
            self.words[word] = k
        return k

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list] = [[] for _ in texts]
        if len(self.words) > self.cache or len(self.shapes) > self.cache:
            self.words, self.shapes = {}, {}
        get, learn = self.words.get, self.shape_id
        ids, owner = [], []
        for i, text in enumerate(texts):
            for m in _LINE.finditer(text):
                words = m[0].split()
                if words:
                    ids.append([get(w) or learn(w) for w in words])
                    owner.append((i, m.start(), m.end()))
        if not ids:
            return out
        lengths = np.array(list(map(len, ids)))
        flat = np.fromiter((x for line in ids for x in line), np.int64, lengths.sum())
        first = np.append(0, np.cumsum(lengths)[:-1])
        before, after = np.append(0, flat[:-1]), np.append(flat[1:], 0)
        before[first] = 0
        after[first + lengths - 1] = 0
        e = self.table[flat, 0] + self.table[before, 1] + self.table[after, 2]
        hopeful = (e[:, 1:].max(axis=1) - e[:, 0] + self.slack) > 0
        lines = np.flatnonzero(np.maximum.reduceat(hopeful, first))
        if not len(lines):
            return out
        for j, path in zip(lines, viterbi([e[first[j] : first[j] + lengths[j]] for j in lines], self.model.change), strict=True):
            if path.any():
                i, start, end = owner[j]
                places = [m.span() for m in _TOKEN.finditer(texts[i], start, end)]
                at = 0
                while at < len(path):
                    stop = at
                    while stop < len(path) and path[stop] == path[at]:
                        stop += 1
                    if path[at]:
                        a, b = places[at][0], places[stop - 1][1]
                        while a < b and not (texts[i][a].isalnum() or texts[i][a] in "(+["):
                            a += 1
                        while a < b and not (texts[i][b - 1].isalnum() or texts[i][b - 1] in ")]"):
                            b -= 1
                        if a < b:
                            out[i].append((KINDS[path[at] - 1], a, b))
                    at = stop
        return out


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts, ends = [], []
    for a, b in sorted(x[1:] for x in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    k = bisect.bisect_left(taken[0], end)
    return k > 0 and taken[1][k - 1] > start


def all_spans(finder: Finder, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of each text by kind and start: those of the patterns, and those of the random field that fit beside them."""
    out = []
    for text, extra in zip(texts, finder.spans(texts), strict=True):
        base = base_spans(text)
        taken = merged(base)
        more = [x for x in extra if not overlaps(taken, x[1], x[2]) and fits(x[0], text[x[1] : x[2]])]
        out.append(sorted([(*x, True) for x in base] + [(*x, False) for x in more], key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def find(docs: DataFrame, model: RandomField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and its spans of personal data, by kind and start, ``base`` for patterns.

    Offsets count code points, the end exclusive. A find of the random field is added if its digits and parts fit its
    kind and it overlaps no pattern's find. A null text counts as empty. Repeated rows stay; an empty table gives no
    rows; columns besides the two named are not read. Time grows linearly with a text, of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(SPAN))])

    def make():
        finder = Finder(shared.value)

        def work(part):
            texts = [t or "" for t in part["text"]]
            return {"id": part["id"], "spans": [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in x] for x in all_spans(finder, texts)]}

        return work

    out = map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", make, schema)
    return out.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with spans as their kinds in angle brackets; spans that overlap become one, of the kind that starts first."""
    out, at, stop = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= stop:
            out += [text[at:start], f"<{kind}>"]
        at = stop = max(stop, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: RandomField | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in texts replaced by its kind in angle brackets, found and replaced in one pass.

    Each row is redacted by itself, so ids may be null, repeated or absent. Overlapping finds go as a whole, under the kind
    of the first. A null text stays null; all other columns pass as they are, whatever their names; an empty table is valid.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    schema = docs.schema

    def run(batches):
        finder = Finder(shared.value)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in pieces_of(batch, at):
                texts = part.column(at).to_pylist()
                new = [t if t is None else masked(t, s) for t, s in zip(texts, all_spans(finder, [t or "" for t in texts]), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of characters in column ``at``."""
    step = max(1, int(SLICE_CHARS // max(1.0, batch.column(at).nbytes / max(1, batch.num_rows))))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
