"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SLICE_CHARS, id_bucket, map_slices, table

#: First code point of each range of letters, with its script.
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"),
]
_FIRST = [x[0] for x in SCRIPT_RANGES]
_WORD = re.compile(r"[^\W\d_]{1,40}")

SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def script_of(letter: str) -> str:
    return SCRIPT_RANGES[max(0, bisect.bisect_right(_FIRST, ord(letter)) - 1)][1]


def _letters(word: str) -> str:
    """Without the numeric characters that are no letters, such as fractions and Roman numerals."""
    return "".join(filter(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; a run of more than 40 letters goes in parts."""
    words = _WORD.findall(text.lower()) if text else []
    return words if all(map(str.isalpha, words)) else [w for w in map(_letters, words) if w]


def gram_keys(text: str) -> np.ndarray:
    """The trigram at each place of ``text`` as a number: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


@dataclass
class LanguageModel:
    """Log-probabilities of character trigrams by language, and the scripts that each language writes."""

    languages: list[str] = field(default_factory=list)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    scripts: dict[str, np.ndarray] = field(default_factory=dict)
    clip: float = 8.0
    even: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __post_init__(self):
        keys = gram_keys("".join(self.grams))[::3] if self.grams else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], np.fromiter(self.grams.values(), np.int64, len(self.grams))[order]
        self.known = np.array([name in self.scripts for _, name in SCRIPT_RANGES])
        self.writes = np.array([self.scripts.get(name, np.zeros(len(self.languages), bool)) for _, name in SCRIPT_RANGES])

    def logs(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word's trigrams in each language."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        keys = gram_keys("".join([f"^{w}$" for w in words]))
        # A word of n letters stands with two marks; so its last two places start no trigram of its own.
        first = np.append(0, np.cumsum(lengths)[:-1])
        keys = keys[np.arange(lengths.sum()) + np.repeat(2 * np.arange(len(words)), lengths)]
        if not len(self.keys):
            return np.add.reduceat(np.repeat(self.table[-1:], len(keys), axis=0), first, axis=0)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.add.reduceat(self.table[np.where(self.keys[at] == keys, self.places[at], -1)], first, axis=0)

    def fit(self, words: list[str], totals: np.ndarray) -> np.ndarray:
        """Evidence that words of these logs fit each language: how much likelier they are than if all trigrams were as likely."""
        lengths = np.fromiter(map(len, words), np.float32, len(words))
        return (totals - lengths[:, None] * self.even).astype(np.float32)

    def score(self, words: list[str], totals: np.ndarray) -> np.ndarray:
        """Score of each language for each word, 0 for the best; languages that don't write the word's script are out."""
        script = np.maximum(0, np.searchsorted(_FIRST, [ord(w[0]) for w in words], side="right") - 1)
        allowed = self.writes[script]
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(self.known[script])
        allowed = allowed[some]
        totals = np.where(allowed, totals[some], -np.inf)
        out[some] = np.maximum(totals - totals.max(axis=1, keepdims=True), np.where(allowed, -self.clip, -4 * self.clip))
        return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_docs_per_language: int = 1500, max_grams: int = 40_000,
) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows: at most about ``max_docs_per_language`` whole texts of each language.

    The sample is chosen by a hash of the id. Rows with a null text or language are not used; with no labelled row the
    model has no language and every text is undetermined.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return LanguageModel()
    parts = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(parts, math.ceil(parts * max_docs_per_language / n)))])
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)) < share[F.col(lang_col)])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def make():
        def work(part):
            seen: Counter = Counter()
            for lang, text in zip(part["lang"], part["text"], strict=True):
                for word in words_of(text):
                    padded = f"^{word}$"
                    seen.update((lang, "gram", padded[i : i + 3]) for i in range(len(word)))
                    seen[lang, "script", script_of(word[0])] += 1
            keys = list(seen)
            return {"lang": [k[0] for k in keys], "kind": [k[1] for k in keys], "gram": [k[2] for k in keys], "n": [seen[k] for k in keys]}

        return work

    counts = map_slices(sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "text", make, schema)
    counts = counts.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max_grams).collect()

    languages = sorted(sizes)
    at = {k: i for i, k in enumerate(languages)}
    grams = {g: i for i, g in enumerate(sorted({r.gram for r in rows if r.kind == "gram"}))}
    n = np.zeros((len(grams) + 1, len(languages)))
    scripts: dict[str, np.ndarray] = {}
    used = {k: sum(r.n for r in rows if r.kind == "script" and r.lang == k) for k in languages}
    for r in rows:
        if r.kind == "gram":
            n[grams[r.gram], at[r.lang]] = r.n
        elif r.n >= 0.01 * used[r.lang]:
            scripts.setdefault(r.gram, np.zeros(len(languages), bool))[at[r.lang]] = True
    smooth = 0.5
    logs = np.log(n + smooth) - np.log(n.sum(axis=0) + smooth * len(n))
    even = -np.log(np.maximum(1, (n > 0).sum(axis=0)))
    return LanguageModel(languages, grams, logs.astype(np.float32), scripts, even=even.astype(np.float32))


def single_language(scores: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text by its total, and whether Viterbi's path surely stays in it.

    It does if no run of words gains more than one penalty in any other language, and a run at the start and one at the
    end gain no more than one penalty together. A path that visits the best language and leaves it for m runs gains m such
    amounts at most and pays m penalties at least. One that never visits it pays m - 1; its first and last run gain one
    penalty at most together and each of the m - 2 between them one, so it is no better either.
    """
    totals = np.add.reduceat(scores, first, axis=0, dtype=np.float64)
    best = totals.argmax(axis=1)
    lengths = np.diff(np.append(first, len(scores)))
    owner = np.repeat(np.arange(len(first)), lengths)
    mine = scores[np.arange(len(scores)), best[owner]].astype(np.float64)
    sure = np.ones(len(first), bool)
    opening, closing = np.zeros(len(first)), np.zeros(len(first))
    for k in range(scores.shape[1]):
        gain = np.cumsum(scores[:, k] - mine)
        before = np.append(0.0, gain[:-1])
        apart = owner * (2.0 * (np.abs(gain).max() + 1.0))
        lowest = np.minimum.accumulate(before - apart) + apart
        sure &= np.maximum.reduceat(gain - lowest, first) <= penalty
        opening = np.maximum(opening, np.maximum.reduceat(gain, first) - before[first])
        closing = np.maximum(closing, gain[first + lengths - 1] - np.minimum.reduceat(before, first))
    return best, sure & (opening + closing <= penalty)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best path of each text; a change of language costs ``penalty``. All texts advance word by word together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    first = np.append(0, np.cumsum(lengths)[:-1])
    came = np.zeros(flat.shape, np.int16)
    value = flat[first].astype(np.float64)
    own = np.arange(flat.shape[1], dtype=np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts with more than t words
    for t in range(1, lengths[0]):
        a = active[t]
        v = value[:a]
        top = v.argmax(axis=1)
        jump = v[np.arange(a), top][:, None] - penalty
        stay = v >= jump
        came[first[:a] + t] = np.where(stay, own, top[:, None].astype(np.int16))
        value[:a] = np.where(stay, v, jump) + flat[first[:a] + t]
    path = np.zeros(len(flat), np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        a = active[t]
        rows = first[:a] + t
        path[rows] = state[:a]
        state[:a] = came[rows, state[:a]] if t else state[:a]
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    for i, at, n in zip(order, first, lengths, strict=True):
        out[i] = path[at : at + n]
    return out


class Labeller:
    """Scores words through a cache of bounded size and labels a batch of texts.

    With ``fits`` it also gives the share of a text's letters in its language, and how well the text fits the languages
    of its spans: the evidence of ``LanguageModel.fit``, a letter.
    """

    def __init__(self, model: LanguageModel, penalty: float, cache: int = 200_000, fits: bool = False):
        self.model, self.penalty, self.cache, self.fits = model, penalty, cache, fits
        self.reset()

    def reset(self) -> None:
        new: list[str] = []
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)
        self.fit_rows = self.rows.copy()

        class Ids(dict):
            def __missing__(self, word):
                k = self[word] = len(self)
                new.append(word)
                return k

        self.ids, self.new = Ids(), new

    def score_new(self, step: int = 20_000) -> None:
        """Score the words that have been met since, many at a time."""
        begin = len(self.ids) - len(self.new)
        while len(self.ids) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.fit_rows = np.concatenate([self.fit_rows, np.zeros_like(self.fit_rows)])
        for at in range(0, len(self.new), step):
            words = self.new[at : at + step]
            place = slice(begin + at, begin + at + len(words))
            totals = self.model.logs(words)
            self.rows[place] = self.model.score(words, totals)
            if self.fits:
                self.fit_rows[place] = self.model.fit(words, totals)
        self.new.clear()

    def label(self, texts: list[str | None]) -> dict[str, list]:
        langs = self.model.languages
        out = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "spans": [[] for _ in texts]}
        if self.fits:
            out |= {"share": [0.0] * len(texts), "fit": [0.0] * len(texts)}
        if len(self.ids) > self.cache:
            self.reset()
        found, ids, letters = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            if words and langs:
                found.append(i)
                ids.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
                letters.append(np.fromiter(map(len, words), np.int64, len(words)))
        if not found:
            return out
        self.score_new()
        lengths = np.array([len(x) for x in ids])
        first = np.append(0, np.cumsum(lengths)[:-1])
        scores = self.rows[np.concatenate(ids)]
        best, sure = single_language(scores, first, self.penalty)
        totals = np.add.reduceat(scores, first, axis=0, dtype=np.float64)
        chance = np.exp(totals - totals.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        mixed = np.flatnonzero(~sure)
        paths = dict(zip(mixed, viterbi([scores[first[j] : first[j] + lengths[j]] for j in mixed], self.penalty), strict=True)) if len(mixed) else {}
        chosen = np.repeat(best, lengths)
        shares = np.ones(len(found))
        for j, i in enumerate(found):
            if j not in paths:
                lang, score, spans = int(best[j]), float(chance[j, best[j]]), [(int(best[j]), 0, int(lengths[j]))]
            else:
                path = paths[j]
                share = np.bincount(path, weights=letters[j], minlength=len(langs))
                lang, score = int(share.argmax()), float(share.max() / share.sum())
                chosen[first[j] : first[j] + lengths[j]], shares[j] = path, score
                edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans = [(int(path[a]), a, b) for a, b in zip(edges, edges[1:])]
                if len(spans) == 1:
                    score = float(chance[j, lang])
            out["lang_pred"][i], out["score"][i] = langs[lang], score
            out["spans"][i] = [{"lang": langs[k], "start": a, "end": b} for k, a, b in spans]
        if self.fits:
            fit = np.add.reduceat(self.fit_rows[np.concatenate(ids), chosen], first, dtype=np.float64) / np.add.reduceat(np.concatenate(letters), first)
            for j, i in enumerate(found):
                out["share"][i], out["fit"][i] = float(shares[j]), float(fit[j])
        return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """One row for each row of ``docs``: its id, language, score and spans of words in one language.

    The language is the one with most letters in its spans, ``und`` (score 0, no spans) for a null text or one without a
    letter. Ties go to the language whose name sorts first. Repeated rows stay; an empty table gives no rows; columns
    besides the two named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])

    def make():
        labeller = Labeller(shared.value, penalty)
        return lambda part: {"id": part["id"]} | labeller.label(part["text"])

    out = map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", make, schema)
    return out.withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", min_share: float = 0.55, min_fit: float = -2.0, penalty: float = 12.0, step_chars: int = SLICE_CHARS
) -> DataFrame:
    """The rows of ``docs`` whose text is mostly in one language that it fits; all columns as they were, no shuffle.

    One language must have at least ``min_share`` of the letters, so even mixtures of two or more go. The text must be
    no less likely in the languages of its spans than ``exp(min_fit)`` a letter times a text of trigrams that are all as
    likely, so letters without a language go. Neither bound depends on the number of languages. Texts without a letter
    go, and all texts if the model has no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value, penalty, fits=True)
        for batch in batches:
            text = batch.column(text_col)
            step = max(1, int(step_chars * batch.num_rows // max(1, text.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = labeller.label(part.column(text_col).to_pylist())
                yield part.filter(pa.array([k != "und" and s >= min_share and f >= min_fit for k, s, f in zip(found["lang_pred"], found["share"], found["fit"], strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(F.coalesce(id_bucket("doc_id", 4) != 2, F.lit(True))))
    return identify(docs, model).select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
