"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy arrays, partly monotonic."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_slices, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the trees, with the sign that the score must follow: -1 falls, 1 rises, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "punct_share": 0, "distinct_share": 0, "bang_share": -1, "pipe_share": -1, "adjacent_share": -1,
}
_DIGIT, _UPPER, _BANG = re.compile("[0-9]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[!?]+")
_PUNCT = re.compile("[.,;:]+")
_SPACE = " \t\n\r\x0b\x0c"
_TO_SPACE = str.maketrans({c: " " for c in "\t\n\r\x0b\x0c"})
_SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[str]:
    """Runs without a space, tab, line feed, vertical tab, form feed or carriage return."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if any(c in text for c in _SPACE[1:]) else [w for w in text.split(" ") if w]


def repeated_words(ids: np.ndarray, owner: np.ndarray, n_docs: int, window: int = 8) -> np.ndarray:
    """For each text, its words inside windows of ``window`` (a power of two) words that it has twice or more.

    Windows get exact ranks by doubling: the rank of a window is that of the pair of its halves.
    """
    out = np.zeros(n_docs, np.int64)
    if not len(ids):
        return out
    rank, half = np.unique(ids + owner * (np.int64(ids.max()) + 1), return_inverse=True)[1].astype(np.int64), 1
    while half < window:
        rank = rank[: len(rank) - half] * (np.int64(rank.max()) + 1) + rank[half:] if len(rank) > half else rank[:0]
        if not len(rank):
            return out
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        half *= 2
    inside = owner[: len(rank)] == owner[window - 1 :]
    twice = (np.bincount(rank[inside], minlength=rank.max() + 1) >= 2)[rank] & inside
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(twice), 1)
    np.add.at(mark, np.flatnonzero(twice) + window, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_docs)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return n


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts and the tree inputs of a batch of texts."""
    texts = [t or "" for t in texts]
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    chars = np.array([sum(map(len, w)) for w in words], np.int64)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, n_words.sum())
    owner = np.repeat(np.arange(len(texts)), n_words)
    same = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    adjacent = np.bincount(owner[1:][same], minlength=len(texts)) if len(ids) else np.zeros(len(texts), np.int64)
    count = lambda rx: np.array([sum(map(len, rx.findall(t))) for t in texts], np.int64)
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    out = {
        "n_words": n_words, "word_chars": chars,
        "n_symbols": np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(ids, owner, len(texts)),
    }
    w, c = np.maximum(1, n_words), np.maximum(1, chars)
    out |= {
        "log_words": np.log1p(n_words), "mean_word": chars / w, "symbol_share": out["n_symbols"] / c,
        "dup_line_share": out["n_dup_lines"] / lines, "repeat_share": out["n_repeat_words"] / w,
        "upper_share": count(_UPPER) / c, "digit_share": count(_DIGIT) / c, "punct_share": count(_PUNCT) / c,
        "distinct_share": np.array([len(set(x)) for x in words]) / w, "bang_share": count(_BANG) / c,
        "pipe_share": np.array([t.count("|") for t in texts]) / w, "adjacent_share": adjacent / w,
    }
    return out


def statistics_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *[T.StructField(k, T.LongType()) for k in BASE], *[T.StructField(k, T.DoubleType()) for k in FEATURES]])


@dataclass
class Forest:
    """Trees in flat arrays: node i tests ``feature`` <= ``threshold`` and goes to ``left`` or ``left + 1``; leaves point to themselves."""

    roots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    depth: int = 0
    bias: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                leaf = self.left[at] == at
                at = np.where(leaf, at, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]))
            out += self.value[at]
        return out


def fit_forest(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32,
    least: int = 20, ridge: float = 5.0,
) -> Forest:
    """Logistic boosting over binned features. A split on a monotonic feature must order its sides, whose values then
    stay on their side of the middle in everything below."""
    rate0 = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    bias = float(np.log(rate0 / (1 - rate0)))
    if len(y) < 2 * least or y.min() == y.max():
        return Forest(bias=bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, value
    roots = []

    def best_split(rows, g, h, low, high):
        best = None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        clip = lambda v: min(high, max(low, v))
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        base = gain_of(total_g, total_h, clip(-total_g / (total_h + ridge)))
        for j, e in enumerate(edges):
            size = len(e) + 1
            gs = np.cumsum(np.bincount(binned[rows, j], g[rows], size))
            hs = np.cumsum(np.bincount(binned[rows, j], h[rows], size))
            ns = np.cumsum(np.bincount(binned[rows, j], minlength=size))
            for b in range(size - 1):
                if ns[b] < least or ns[-1] - ns[b] < least:
                    continue
                vl, vr = clip(-gs[b] / (hs[b] + ridge)), clip(-(total_g - gs[b]) / (total_h - hs[b] + ridge))
                if signs[j] * (vr - vl) < 0:
                    continue
                gain = gain_of(gs[b], hs[b], vl) + gain_of(total_g - gs[b], total_h - hs[b], vr) - base
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, j, b, vl, vr)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), 0.0])
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            value = min(high, max(low, -g[rows].sum() / (h[rows].sum() + ridge)))
            nodes[at][3] = value * rate
            split = best_split(rows, g, h, low, high) if level < depth else None
            if not split:
                margin[rows] += value * rate
                continue
            _, j, b, vl, vr = split
            nodes[at][:3] = [j, float(edges[j][b]), len(nodes)]
            nodes += [[0, 0.0, len(nodes), 0.0], [0, 0.0, len(nodes) + 1, 0.0]]
            goes = binned[rows, j] <= b
            middle = (vl + vr) / 2
            bounds = [(low, high), (low, high)] if not signs[j] else [(low, middle), (middle, high)][:: signs[j]]
            work += [(nodes[at][2], rows[goes], level + 1, *bounds[0]), (nodes[at][2] + 1, rows[~goes], level + 1, *bounds[1])]
    f, t, left, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(np.array(roots, np.int32), f.astype(np.int32), t, left.astype(np.int32), v, depth, bias)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8_000
) -> Forest:
    """Fit on a bounded sample: at most about ``max_rows`` labelled rows with a text, chosen by a hash of the id.

    With fewer than 40 rows, or labels of one kind, the forest has no tree and gives the same score to all.
    """
    parts = 1_000_000
    labelled = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    share = min(1.0, max_rows / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < int(parts * share)).dropDuplicates(["id"]).limit(2 * max_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    schema = T.StructType([T.StructField("label", T.DoubleType()), *[T.StructField(k, T.DoubleType()) for k in FEATURES]])

    def make():
        return lambda part: {"label": part["label"]} | {k: v for k, v in statistics(part["text"]).items() if k in FEATURES}

    rows = np.array([tuple(r) for r in map_slices(sample, "text", make, schema).collect()], float).reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T)]
    return fit_forest(rows[:, 1:], rows[:, 0], list(FEATURES.values()))


def judge(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
    max_repeat_percent: int = 30, reject_below: float = 0.3,
) -> DataFrame:
    """One row for each row of ``docs``: its id, base counts, base verdict, quality (0 to 1) and whether it is kept.

    A text is kept if it passes the base rules and its quality reaches ``reject_below``. A null text has no words and
    fails. Repeated rows stay; an empty table gives no rows; columns besides the two named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*statistics_schema(docs.schema[id_col].dataType).fields[: 1 + len(BASE)], T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def make():
        forest = shared.value

        def work(part):
            s = statistics(part["text"])
            quality = 1 / (1 + np.exp(-forest.margin(np.stack([s[k] for k in FEATURES], axis=1))))
            failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
            return {"id": part["id"]} | {k: s[k] for k in BASE} | {"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= reject_below)}

        return work

    out = map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", make, schema)
    return out.withColumnRenamed("id", id_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
