"""Phrase collocation mining over routed suffixes (query ``op11_collocations``).

Every word begins a suffix of up to five words inside its piece. Suffixes are dealt to tasks by their leading words, by as
many as it takes for no group to be large, and each task sorts pointers to its suffixes by multikey three-way quicksort: a
partition whose first d words are equal has as many suffixes as the phrase of these words has occurrences. Partitions below
the wanted frequency are abandoned.

Two passes over the texts. The first counts words, pairs and triples in hash buckets of fixed number, finds leading words
that are too common for one task, and counts all words. The second leaves out what no frequent phrase can hold (a bucket's
count is never less than that of a phrase in it), merges equal suffixes of a task's run, and routes them. Buckets and routes
decide where work happens, never a result: phrases are compared by their words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import slices, table, written

#: Tokens that a task holds at a time, characters of one step of it, and suffixes that a task sorts at a time.
RUN_TOKENS, STEP_CHARS, SORT_ROWS = 5_000_000, 4_000_000, 500_000
#: Bits of the numbers of buckets for phrases of one, two and three words, and buckets in one block of a table of counts.
BITS, BLOCK = {"word": 20, "pair": 22, "triple": 22}, 4096
#: Groups of suffixes hold at most about this share of all words; the list of more common leading words is as long at most.
GROUPS = 4096
#: Buckets that suffixes are dealt in; a task holds the suffixes of one at least.
BUCKETS = 4096
#: Languages whose counts of words are broadcast at most.
BROADCAST_LANGS = 10_000

_END = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Vocabulary(dict):
    """Ids of words in order of first use; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in self), "u8", len(self))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


def _first_hash(words: np.ndarray, lang: str) -> np.ndarray:
    """The hash of phrases of one word; ``_next_hash`` adds words."""
    return _mixed(words * _K1 + np.uint64(xxhash.xxh64_intdigest(lang, 12)))


def _next_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(before * _K2 + words)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Vocabulary, dict[str, np.ndarray]]]:
    """Vocabularies with the ids of words by language, a bounded number of words at a time; pieces lie between zeros."""
    vocabulary, parts, size = _Vocabulary(), {}, 0
    whole = lambda: {lang: np.concatenate([*p, [0] * 8]).astype("i4") for lang, p in parts.items()}
    for columns in slices(batches, "text", STEP_CHARS):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(columns["lang"], columns["text"], strict=True):
            by_lang.setdefault(lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            words = b"".join([_END, _END.join(texts)]).translate(_FOLD).replace(_END, b" . ").split()
            ids = np.fromiter(map(vocabulary.__getitem__, words), "i4", len(words))
            parts.setdefault(lang, []).append(ids)
            size += len(ids)
        if size >= RUN_TOKENS:
            yield vocabulary, whole()
            vocabulary, parts, size = _Vocabulary(), {}, 0
    if size:
        yield vocabulary, whole()


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype("i8")


_COUNTS = "kind string, lang string, key long, n long, body binary"
_COUNTS_ARROW = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def first_pass(texts: DataFrame, least: int, longest: int) -> DataFrame:
    """Rows of three kinds: ``words`` (words of a language), ``hot`` (common leading words by hash, as far as a run has
    many), and blocks of the bucket counts of ``BITS``, each count up to ``least``."""
    kind = "u1" if least <= 255 else "u4"

    def run(batches):
        tables = {name: np.zeros(1 << bits, "i4") for name, bits in BITS.items()}

        def add(name, h, weights=None):
            t = tables[name]
            t += np.bincount(_buckets(h, BITS[name]), weights=weights, minlength=len(t)).astype("i4")
            np.minimum(t, least, out=t)

        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS_ARROW, strict=True)], schema=_COUNTS_ARROW)
        for vocabulary, by_lang in runs(batches):
            hashes = vocabulary.hashes()
            many = max(1, sum(int((ids > 0).sum()) for ids in by_lang.values()) // (2 * GROUPS))
            rows = []
            for lang, ids in by_lang.items():
                counts = np.bincount(ids, minlength=len(hashes))
                counts[0] = 0
                rows.append(("words", lang, None, int(counts.sum()), None))
                ones = _first_hash(hashes, lang)
                add("word", ones, counts)
                at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                h = _next_hash(ones[ids[at]], hashes[ids[at + 1]])
                add("pair", h)
                longer = ids[at + 2] > 0
                add("triple", _next_hash(h[longer], hashes[ids[at[longer] + 2]]))
                common = np.flatnonzero(counts >= many)
                rows += [("hot", None, int(ones[w].view("i8")), int(counts[w]), None) for w in common]
                at = np.flatnonzero((counts >= many)[ids])
                h = ones[ids[at]]
                for d in range(1, longest - 1):
                    inside = ids[at + d] > 0
                    at, h = at[inside], h[inside]
                    h, place, n = np.unique(_next_hash(h, hashes[ids[at + d]]), return_inverse=True, return_counts=True)
                    rows += [("hot", None, int(x.view("i8")), int(k), None) for x, k in zip(h[n >= many], n[n >= many], strict=True)]
                    at, h = at[(n >= many)[place]], h[place][(n >= many)[place]]
            yield batch(rows)
        for name, counted in tables.items():
            blocks = counted.astype(kind).reshape(-1, BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            for part in np.array_split(used, max(1, len(used) // 64)):
                if len(part):
                    yield batch([(name, None, int(k), None, blocks[k].tobytes()) for k in part])

    return texts.mapInArrow(run, _COUNTS)


def full_buckets(counts: DataFrame, least: int) -> dict[str, np.ndarray]:
    """Whether each bucket's count reaches ``least``, by kind. The blocks are added up by Spark tasks, a row at a time."""
    kind = "u1" if least <= 255 else "u4"

    def run(batches):
        schema = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("bits", pa.binary())])
        of, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*of, np.packbits(total >= least).tobytes()), schema, strict=True)], schema=schema)
        for b in batches:
            for name, key, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (name, key) != of:
                    if of:
                        yield out()
                    of, total = (name, key), np.zeros(BLOCK, "i8")
                total += np.frombuffer(body, kind)
        if of:
            yield out()

    blocks = counts.where(F.col("kind").isin(*BITS)).select("kind", "key", "body").repartition("kind", "key").sortWithinPartitions("kind", "key")
    full = {name: np.zeros(1 << bits, bool) for name, bits in BITS.items()}
    for r in blocks.mapInArrow(run, "kind string, key long, bits binary").toLocalIterator():
        full[r.kind][r.key * BLOCK : (r.key + 1) * BLOCK] = np.unpackbits(np.frombuffer(r.bits, "u1")).astype(bool)
    return full


def distinct_rows(columns: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, group of each row, and sizes of the groups of equal rows; values are at most ``top``."""
    bits = max(1, int(top).bit_length())
    key, used = columns[0].astype("i8"), bits
    for c in columns[1:]:
        if used + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
            used = len(key).bit_length()
        key, used = (key << bits) | c, used + bits
    _, first, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, group, n


_SUFFIXES = "bucket int, lang string, phrases array<string>, bases binary, counts binary"


def suffixes(texts: DataFrame, full: dict[str, np.ndarray], hot: np.ndarray, longest: int) -> DataFrame:
    """``bucket, lang, phrases, bases, counts``: merged suffixes of runs, many in a row. A suffix counts for its leading
    phrases of ``base`` words and more; phrases of fewer words are too common for one task and have entries of their own.
    All that counts for a phrase is in one bucket."""
    shared = texts.sparkSession.sparkContext.broadcast({name: np.packbits(bits) for name, bits in full.items()} | {"hot": np.sort(hot.view("u8"))})

    def run(batches):
        known = {name: np.unpackbits(shared.value[name]).view(bool) for name in BITS}
        may_be = lambda name, h: known[name][_buckets(h, BITS[name])]
        hot = shared.value["hot"]

        def is_hot(h):
            at = np.searchsorted(hot, h)
            return (hot[np.minimum(at, len(hot) - 1)] == h) if len(hot) else np.zeros(len(h), bool)

        for vocabulary, by_lang in runs(batches):
            hashes, names = vocabulary.hashes(), pa.array(list(vocabulary), pa.binary()).cast(pa.string())
            for lang, ids in by_lang.items():
                ones = _first_hash(hashes, lang)
                may = may_be("word", ones)
                may[0] = False
                good = may[ids]
                at = np.flatnonzero(good[:-1] & good[1:])
                h = _next_hash(ones[ids[at]], hashes[ids[at + 1]])
                at, h = at[kept := may_be("pair", h)], h[kept]
                pair, triple = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
                pair[at] = True
                longer = pair[at + 1]
                triple[at[longer][may_be("triple", _next_hash(h[longer], hashes[ids[at[longer] + 2]]))]] = True
                alone = np.bincount(ids[good & ~pair], minlength=len(hashes))
                single = np.flatnonzero(alone)
                goes_on, rest = np.ones(len(at), bool), []
                for d in range(1, longest):
                    goes_on = goes_on & triple[at + d - 2] if d > 1 else goes_on
                    rest.append(np.where(goes_on, ids[at + d], 0))
                columns = [ids[at], *rest]
                first, _, n = distinct_rows(columns, len(hashes)) if len(at) else (at, at, at)
                columns = [np.r_[single, columns[0][first]], *[np.r_[np.zeros(len(single), "i4"), c[first]] for c in rest]]
                n = np.r_[alone[single], n].astype("i8")
                yield from _records(list(routed(columns, n, ones, hashes, is_hot)), names, lang)

    return texts.mapInArrow(run, _SUFFIXES)


def routed(columns, n, ones, hashes, is_hot) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, int]]:
    """Suffixes with their counts, routes and base: those whose first ``base`` words are the first that aren't hot, and the
    hot phrases before them."""
    rest, h = np.arange(len(n)), ones[columns[0]]
    for d in range(1, len(columns) + 1):
        if d > 1:
            longer = columns[d - 1][rest] > 0
            rest, h = rest[longer], h[longer]
            h = _next_hash(h, hashes[columns[d - 1][rest]])
        hot = is_hot(h) & (d < len(columns))
        yield [c[rest[~hot]] for c in columns], n[rest[~hot]], h[~hot], d
        rest, h = rest[hot], h[hot]
        if not len(rest):
            break
        first, group, _ = distinct_rows([c[rest] for c in columns[:d]], len(hashes))
        here = [c[rest[first]] if k < d else np.zeros(len(first), "i4") for k, c in enumerate(columns)]
        yield here, np.bincount(group, weights=n[rest]).astype("i8"), h[first], d


def _records(parts: list, names: pa.Array, lang: str, step: int = 256) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
    n, base = np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[1]), p[3], "i1") for p in parts])
    bucket = (np.concatenate([p[2] for p in parts]) % np.uint64(BUCKETS)).astype("i4")
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    for at in range(0, len(used), step):
        lo, hi = starts[at : at + step], ends[at : at + step]
        part = order[lo[0] : hi[-1]]
        words = [pc.take(names, pa.array(c[part], mask=c[part] == 0)) for c in columns]
        phrases = pa.ListArray.from_arrays(np.r_[lo, hi[-1]].astype("i4") - lo[0], pc.binary_join_element_wise(*words, " ", null_handling="skip"))
        cut = lambda values: pa.array([values[order[a:b]].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(used[at : at + step]), pa.array([lang] * len(lo)), phrases, cut(base), cut(n)], names=["bucket", "lang", "phrases", "bases", "counts"])


def equal_partitions(keys: np.ndarray, base: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the rows of ``keys``, by column; 0 is the end of a row.

    Gives ``row, depth, count`` of each partition of rows that agree in their first ``depth + 1`` columns and count
    ``least`` or more there: the ``n`` of rows whose ``base`` is ``depth`` or less. Lighter partitions are abandoned.
    """
    todo = [(np.arange(len(n)), 0)] if len(n) else []
    while todo:
        rows, depth = todo.pop()
        k = keys[rows, depth]
        a, b, c = k[0], k[len(k) // 2], k[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        for part in (rows[k < pivot], rows[k > pivot]):
            if len(part) and n[part].sum() >= least:
                todo.append((part, depth))
        if pivot:
            same = rows[k == pivot]
            weight = n[same]
            if weight.sum() >= least:
                count = int(weight[base[same] <= depth].sum())
                if count >= least and depth:
                    yield int(same[0]), depth, count
                if depth + 1 < keys.shape[1]:
                    todo.append((same, depth + 1))


_FREQUENT = "lang string, phrase string, words int, f long"


def frequent_phrases(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases with ``least`` occurrences or more; a task sorts a few buckets at a time."""
    dealt = routed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        for t in whole_buckets(batches):
            phrases = t.column("phrases").combine_chunks()
            sizes = np.diff(phrases.offsets.to_numpy())
            split = pc.split_pattern(phrases.flatten(), " ")
            words = split.flatten().dictionary_encode()
            lengths = np.diff(split.offsets.to_numpy())
            keys = np.zeros((len(lengths), longest + 1), "i4")
            row = np.repeat(np.arange(len(lengths)), lengths)
            keys[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1] = words.indices.to_numpy() + 1
            langs = t.column("lang").combine_chunks().dictionary_encode()
            keys[:, 0] = np.repeat(langs.indices.to_numpy() + 1, sizes)
            base, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("bases", "i1"), ("counts", "i8")))
            found = list(equal_partitions(keys, base, n, least))
            if found:
                texts = [" ".join(words.dictionary[int(k) - 1].as_py() for k in keys[r, 1 : d + 1]) for r, d, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs.dictionary[int(keys[r, 0]) - 1].as_py() for r, _, _ in found]), pa.array(texts), pa.array([d for _, d, _ in found], pa.int32()), pa.array([c for _, _, c in found], pa.int64())],
                    names=["lang", "phrase", "words", "f"],
                )

    return dealt.mapInArrow(run, _FREQUENT)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of about ``SORT_ROWS`` suffixes that hold each bucket whole; ``batches`` are sorted by bucket."""
    held, size, last = [], 0, None
    for batch in batches:
        bucket, many = batch.column("bucket").to_numpy(), pc.list_value_length(batch.column("phrases")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                if held and bucket[a] != last and size >= SORT_ROWS:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + int(many[a:b].sum()), bucket[a]
    if held:
        yield pa.Table.from_batches(held)


def scored(frequent: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all phrases of two words and more, by their lowest-scoring cut."""
    cut = frequent.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    first = F.expr("substring_index(phrase, ' ', k)")
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", first.alias("first"), F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)").alias("rest"))
    side = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(words, "lang")
    whole = lambda c, digits: f"CAST({c} AS DECIMAL({digits}, 0))"
    score = F.expr(f"({whole('1000 * a', 19)} * {whole('n', 18)}) DIV ({whole('l', 18)} * {whole('r', 18)})")
    lowest = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return lowest.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def not_inside(frequent: DataFrame, share: int) -> DataFrame:
    """``lang, phrase`` of phrases that lie in a longer one with ``share`` percent of their occurrences or more."""
    ends = F.array(
        F.struct(F.expr("substring_index(phrase, ' ', words - 1)").alias("phrase"), F.lit(1).alias("one")),
        F.struct(F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)").alias("phrase"), F.lit(1).alias("one")),
    )
    inner = frequent.where("words > 2").select("lang", F.explode(ends).alias("e"), "f").groupBy("lang", F.col("e.phrase").alias("phrase")).agg(F.max("f").alias("most"))
    return frequent.join(inner, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * share).select("lang", "phrase")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases (all, if None) of 2 to ``longest`` words.

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends, and those into words between spaces and
    tabs. ``longest`` is 8 at most. ``a`` counts the occurrences of a phrase, at least ``least``; ``n`` all words of the language. Each cut into two
    parts with ``l`` and ``r`` occurrences scores ``floor(1000 a n / (l r))``, in whole numbers of 38 digits; the lowest
    score counts, ties go to the shortest first part. A phrase that lies in a longer one as frequent as itself is left out.
    Ranks go by score and ``a``, highest first, then by phrase.

    A null text is empty, a null language is ``und``; ids are not read and repeated rows count each. Languages without a
    frequent phrase, and an empty table, have no rows. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''")
    counts = written(first_pass(texts, least, longest))
    words = counts.where("kind = 'words'").groupBy("lang").agg(F.sum("n").alias("n"))
    total = counts.where("kind = 'words'").agg(F.sum("n")).first()[0] or 0
    hot = counts.where("kind = 'hot'").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, total // (2 * GROUPS))).select("key")
    full = full_buckets(counts, least)
    routed = suffixes(texts, full, np.array([r.key for r in hot.toLocalIterator()], "i8"), longest)
    frequent = written(frequent_phrases(routed, least, longest))
    words = F.broadcast(words) if words.count() <= BROADCAST_LANGS else words
    # A longer phrase is at most as frequent, and so is each phrase between: looking one word further is enough.
    kept = scored(frequent, words).join(not_inside(frequent, 100), ["lang", "phrase"], "left_anti")
    return _ranked(kept, top)


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # the first of parts of a language before the first of the whole
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    rank: Column = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    rows = rows.withColumn("rank", rank)
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAM = lambda k: f"SELECT lang, {k} AS words, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces WHERE len(ws) >= {k}) x"
_SQL = rf"""WITH pieces AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) p),
 total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY 1),
 f AS (SELECT lang, words, phrase, count(*) AS f FROM ({" UNION ALL ".join(_GRAM(k) for k in range(1, 6))}) g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
 c AS (SELECT *, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
 s AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, k, (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(ws, 1, k), ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(ws, k + 1, c.words), ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
 kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = s.lang AND q.words > len(string_split(s.phrase, ' ')) AND 100 * q.f >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {"op11_collocations": _SQL}
