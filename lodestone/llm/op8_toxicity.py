"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, less exception phrases, normalised by length."""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import id_bucket, map_slices, table, written

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "σ": "o", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ß": "ss",
}
#: Digits and signs written for letters; i, l and 1 fold to one letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
_ASCII = {ord(a): b for a, b in SUBSTITUTES.items() if a in "l"} | {c: chr(c + 32) for c in range(65, 91)} | {ord("L"): "i"}
_MAP = str.maketrans(_ASCII | {ord(a): b.replace("l", "i") for a, b in HOMOGLYPHS.items()} | {ord(a): "" for a in "​‌‍­﻿"})
_MIXED = re.compile(r"[@$]?[^\W_]+(?:[@$]+[^\W_]+)*")
_TO_LETTERS = str.maketrans({a: b for a, b in SUBSTITUTES.items() if a != "l"})
_GAPS = re.compile(r"[^a-z]+")


def fold(text: str) -> str:
    """Words of folded Latin letters, with one space around each: accents, look-alikes and substitutions undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.lower())
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = text.translate(_MAP)
    if "@" in text or "$" in text or any(d in text for d in "0123456789"):
        text = _MIXED.sub(lambda m: m[0].translate(_TO_LETTERS) if any(map(str.isalpha, m[0])) else m[0], text)
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass
class ToxicModel:
    """Folded words and stems with weights (a space marks the edge of a word), phrases that excuse them, and the logistic curve from load to score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -2.0
    length_power: float = 0.25

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase, weight in self.weights.items():
            found.add_word(phrase, (len(phrase), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def score(self, load: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * load + self.bias, -30, 30)))


def hits_of(found: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """Start, end and weight of the matches that lie in no exception phrase, in order of their ends."""
    hits, excused = [], []
    for end, (length, weight) in found.iter(folded):
        (excused if weight is None else hits).append((end - length + 1, end, weight))
    if not excused or not hits:
        return hits
    excused.sort()
    starts, reach = [x[0] for x in excused], np.maximum.accumulate([x[1] for x in excused])
    at = [bisect.bisect_right(starts, a) - 1 for a, _, _ in hits]
    return [h for h, k in zip(hits, at, strict=True) if k < 0 or reach[k] < h[1]]


def load_of(found: ahocorasick.Automaton, text: str | None, power: float) -> tuple[float, int]:
    """Weight of the matches outside exceptions, over the number of words to a power; and the number of those matches."""
    if not text or not len(found):
        return 0.0, 0
    folded = fold(text)
    hits = hits_of(found, folded)
    return sum(h[2] for h in hits) / max(1, folded.count(" ") - 1) ** power, len(hits)


def around(folded: str, start: int, end: int) -> list[str]:
    """The phrases of two words, with their spaces, that a match makes with the word before and the word after it."""
    first = folded.rfind(" ", 0, start + 1)
    last = folded.find(" ", max(end, start + 1))
    before, after = folded.rfind(" ", 0, max(first, 0)), folded.find(" ", last + 1)
    return [folded[a : b + 1] for a, b in ((before, last), (first, after)) if a >= 0 and b >= 0 and first >= 0 and last >= 0]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 8_000, max_terms: int = 200, min_share: float = 0.02, min_excused: int = 3,
) -> ToxicModel:
    """Learn the lexicon from a bounded sample: at most about ``max_rows`` labelled rows, chosen by a hash of the id.

    Terms are whole words and stems (first letters of words, 4 to 8 of them). A term enters if at least ``min_share`` of
    the toxic texts have it and it is several times as frequent in them as in others; of a stem and its extensions the
    one that tells most stays. Its weight is the logarithm of the ratio of its frequencies. An exception is a phrase of two words
    around a match that at least ``min_excused`` of the other texts have and at most a tenth as large a share of the toxic ones. Rows without a label or text
    are not used. With no label of one kind nothing is learned, and every text scores alike, under one half.
    """
    labelled = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    parts = 1_000_000
    share = min(1.0, max_rows / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < int(parts * share)).dropDuplicates(["id"]).limit(2 * max_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")

    seen = T.StructType([T.StructField("term", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("uses", T.LongType())])

    def make():
        def work(part):
            docs_with, uses = Counter(), Counter()
            for text, label in zip(part["text"], part["label"], strict=True):
                terms: Counter = Counter()
                words = Counter(fold(text).split())
                for word, n in words.items():
                    if len(word) > 2:
                        terms[f" {word} "] += n
                        for k in range(4, min(9, len(word))):
                            terms[f" {word[:k]}"] += n
                terms[""] = words.total()
                docs_with.update((t, label) for t in terms)
                uses.update({(t, label): n if t == "" else min(n, 1 + words.total() // 20) for t, n in terms.items()})
            return {"term": [t for t, _ in uses], "label": [x for _, x in uses], "docs": list(map(docs_with.get, uses)), "uses": list(uses.values())}

        return work

    counts = map_slices(sample, "text", make, seen)
    of = lambda column, label: F.sum(F.when(F.col("label") == label, F.col(column)).otherwise(0))
    stats = written(counts.groupBy("term").agg(of("docs", 1).alias("t"), of("docs", 0).alias("c"), of("uses", 1).alias("tu"), of("uses", 0).alias("cu")).where("term = '' or t >= 3"))
    total = stats.where("term = ''").collect()
    if not total or not total[0].t or not total[0].c:
        return ToxicModel(bias=-1.0)
    toxic, toxic_words, clean_words = total[0].t, total[0].tu, total[0].cu
    least = max(3, math.ceil(min_share * toxic))
    ratio = F.log(((F.col("tu") + 0.5) / toxic_words) / ((F.col("cu") + 0.5) / clean_words))
    terms = (
        stats.where((F.col("term") != "") & (F.col("t") >= least) & (ratio > 2.0) & (F.col("t") * 2 > F.col("c")))
        .select("term", ratio.alias("weight"), (F.col("t") * ratio * (1 + 0.01 * F.length("term"))).alias("gain"))
        .orderBy(F.desc("gain"), "term").limit(20 * max_terms).collect()
    )
    model = ToxicModel()
    for r in terms:
        if len(model.weights) < max_terms and not any(r.term.startswith(x) or x.startswith(r.term.rstrip()) for x in model.weights):
            model.weights[r.term] = min(8.0, r.weight)

    match = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("phrases", T.ArrayType(T.StringType()))])
    matches = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(match))])

    def make_matches():
        found = model.automaton()

        def work(part):
            texts = [fold(t) for t in part["text"]]
            hits = [[{"weight": w, "phrases": around(t, a, b)} for a, b, w in hits_of(found, t)] if len(found) else [] for t in texts]
            return {"label": part["label"], "n_words": [max(1, t.count(" ") - 1) for t in texts], "hits": hits}

        return work

    rows = map_slices(sample, "text", make_matches, matches).collect()
    y = np.array([r.label for r in rows], float)
    seen = [Counter(p for r in rows if r.label == k for p in {p for h in r.hits for p in h.phrases}) for k in (0, 1)]
    share = lambda p, k: seen[k][p] / max(1, (y == k).sum())
    model.exceptions = tuple(sorted(p for p, n in seen[0].items() if n >= min_excused and 10 * share(p, 1) <= share(p, 0)))
    excused = set(model.exceptions)
    weight = np.array([sum(h.weight for h in r.hits if not excused.intersection(h.phrases)) for r in rows])
    words = np.array([r.n_words for r in rows], float)
    fits = [(*logistic(weight / words**p, y), p) for p in (0.0, 0.25, 0.5, 0.75)]
    _, model.slope, model.bias, model.length_power = min(fits)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Loss, slope and bias of a one-feature logistic regression, by Newton steps with a small ridge."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(a), float(b)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, score (0 to 1), predicted label and number of matches.

    Null and empty texts and texts without a match get the score of no load. Repeated rows stay; an empty table gives
    no rows; columns besides the two named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.LongType())])

    def make():
        model = shared.value
        found = model.automaton()

        def work(part):
            loads = [load_of(found, t, model.length_power) for t in part["text"]]
            s = model.score(np.array([x for x, _ in loads]))
            return {"id": part["id"], "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist(), "n_matches": [n for _, n in loads]}

        return work

    out = map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", make, schema)
    return out.withColumnRenamed("id", id_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(id_bucket("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_matches")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
