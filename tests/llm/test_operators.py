"""Each operator against brute force on the smallest tables, and on a table of hard rows."""

import itertools
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import op1_packing, op2_language, op3_simhash, op4_decontaminate, op5_lines, op6_pii, op7_warc, op8_toxicity, op9_quality, op10_licenses
from lodestone.llm.common import table
from lodestone.llm.components import components

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, None), (2, ""), (3, "   \n\n"), (4, "x"), (5, "The same text here.\nThe same text here."), (5, "The same text here.\nThe same text here."),
        (6, "The same text here.\nThe same text here."), (None, "A row without an id."), (7, " ".join(f"w{i % 997}" for i in range(60_000))), (8, "été ÉTÉ привет мир 你好 😀 a@b.co +1 (555) 010-9999"),
        (9, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "fp", "words", "lang", "source", "n_words", "text_hash", "score", "spans", "n_removed", "tokens"):
        df = df.withColumn(c, F.lit(c))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def lower(t):
    return t.encode().lower().decode()


def test_packing_round_trip(spark, texts):
    rows = op1_packing.op1_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert pieces.keys() == ids.keys()
    for k, p in pieces.items():
        at = 0
        for start, length in sorted(p):
            assert start == at
            at += length
        assert at == len(ids[k])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
    for s in sequences.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and len(s) <= op1_packing.SEGMENTS and sum(x[2] for x in s) <= 4096
        assert at == 4096 or at & (at - 1) == 0


def test_packing_limits_and_prompts(spark):
    df = spark.createDataFrame([(i, "a b c " * (i + 1), "answer the question " * i) for i in range(50)], "doc_id long, prompt string, text string")
    rows = op1_packing.pack(df, TOKENIZER, prompt_col="prompt", max_tokens=64, max_segments=3, max_loss_tokens=40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(len(s) <= 3 and sum(x.loss_tokens for x in s) <= 40 and sum(x.length for x in s) <= 64 for s in by.values())
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_packing_makes_progress_under_any_limits(spark):
    df = spark.createDataFrame([(i, "a b c d e " * i, "answer the question " * i) for i in range(12)], "doc_id long, prompt string, text string")
    for tokens, segments, loss in ((64, 1, 64), (64, 64, 1), (64, 3, 4), (1, 1, 1), (7, 2, 3)):
        for prompt in (None, "prompt"):
            rows = op1_packing.pack(df, TOKENIZER, prompt_col=prompt, max_tokens=tokens, max_segments=segments, max_loss_tokens=loss).collect()
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
            by = {}
            for r in rows:
                by.setdefault(r.sequence_id, []).append(r)
            assert all(len(s) <= segments and sum(x.loss_tokens for x in s) <= loss and sum(x.length for x in s) <= tokens for s in by.values())


def test_each_packing_limit_binds(spark):
    sf = "/root/testdata/sf0.01"
    sequences = lambda df: df.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"), F.sum("loss_tokens").alias("l"))
    of_documents = sequences(op1_packing.op1_packing(spark, sf)).agg(F.max("n"), F.max("t"), F.avg("t")).first()
    assert of_documents[0] == op1_packing.SEGMENTS and of_documents[1] == 4096 and of_documents[2] > 2000
    of_instructions = sequences(op1_packing.instruction_packing(spark, sf)).agg(F.max("n"), F.max("l")).first()
    assert of_instructions[0] <= 64 and of_instructions[1] == 1536


@pytest.mark.parametrize(("limits", "part_tokens"), [({}, 1 << 16), ({"max_tokens": 128, "max_segments": 3, "max_loss_tokens": 50}, 60), ({"max_tokens": 32, "max_segments": 2, "max_loss_tokens": 1}, 1 << 16)])
def test_packing_of_conversations_round_trip(spark, limits, part_tokens):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    given = table(spark, "/root/testdata/sf0.01", "conversations").where("conv_id < 25").unionByName(spark.createDataFrame([
        (900, 0, "assistant", "alone"), (901, 0, "system", "nobody answers"), (902, 5, "user", "late"), (902, None, "assistant", "first"), (902, 9, "assistant", None), (902, 9, "assistant", None), (None, 1, None, "x y"), (903, 1, "assistant", "word " * 300),
    ], "conv_id long, turn long, role string, text string"))
    examples = {}
    for r in sorted(given.collect(), key=lambda r: (-1 if r.turn is None else r.turn, r.role or "", r.text or "")):
        new = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        parts = examples.setdefault("none" if r.conv_id is None else str(r.conv_id), [([], [])])
        if len(parts[-1][0]) >= part_tokens:
            parts.append(([], []))
        parts[-1][0].extend(new)
        parts[-1][1].extend([r.role == "assistant"] * len(new))
    want = {f"{c}/{k}": p for c, parts in examples.items() for k, p in enumerate(parts)}
    rows = op1_packing.pack_conversations(given.withColumn("conv", F.lit(1)), TOKENIZER, part_tokens=part_tokens, **limits).collect()
    most = {"max_tokens": 4096, "max_segments": 64, "max_loss_tokens": 1536} | limits
    sequences, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.example_id, r.start)):
        ids, bears = want[r.example_id]
        assert r.start == at.get(r.example_id, 0) and r.doc_tokens == len(ids)
        at[r.example_id] = r.start + r.length
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.loss_tokens == sum(bears[r.start + 1 : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append(r)
    assert at == {k: len(p[0]) for k, p in want.items()}
    for s in sequences.values():
        assert len(s) <= most["max_segments"] and sum(r.length for r in s) <= most["max_tokens"] and sum(r.loss_tokens for r in s) <= most["max_loss_tokens"]
    assert op1_packing.pack_conversations(given.limit(0), TOKENIZER).count() == 0


def test_cached_tokens_equal_the_tokenizer():
    from lodestone.llm.tokens import WordIds

    words, tokenizer = WordIds(TOKENIZER, cache=50), Tokenizer.from_file(TOKENIZER)
    for t in ["Don't STOP, it's 12.5% off!!", "été ÉCOLE ß İstanbul ΣΑΣ", "a\x1cb\x85c d", "é <|endoftext|> x", "привет 你好 😀", "½ ² ª", "", "  ", "ſ ŉ"]:
        assert words.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_language_accuracy_and_spans(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = op2_language.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = op2_language.train(docs)
    parts = [r.text for lang in ("en", "de") for r in docs.where(F.col("lang") == lang).where("length(text) > 400").orderBy("doc_id").limit(1).collect()]
    mixed = spark.createDataFrame([(1, " ".join(p[:400] for p in parts))], "doc_id long, text string")
    assert [s.lang for s in op2_language.identify(mixed, model).first().spans] == ["en", "de"]


def test_language_needs_letters(spark):
    model = op2_language.train(table(spark, SF, "documents"))
    rows = [(1, "½ ²"), (2, "Ⅷ ①"), (3, None), (4, "12 !"), (5, "the ½ of it was on the table")]
    got = {r.doc_id: r.lang_pred for r in op2_language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}


def test_language_shortcut_agrees_with_viterbi():
    draw = np.random.default_rng(3)
    texts = [draw.choice([0.0, -3.0, -8.0], size=(n, 3)) for n in draw.integers(1, 60, 200)]
    first = np.append(0, np.cumsum([len(t) for t in texts])[:-1])
    best, sure = op2_language.single_language(np.concatenate(texts), first, 5.0)
    paths = op2_language.viterbi(texts, 5.0)
    for t, b, s, p in zip(texts, best, sure, paths):
        value = lambda path: t[np.arange(len(t)), path].sum() - 5.0 * (np.diff(path) != 0).sum()  # noqa: B023, E731
        scores = t[0].copy()
        for row in t[1:]:
            scores = row + np.maximum(scores, scores.max() - 5.0)
        assert abs(value(p.astype(int)) - scores.max()) < 1e-6
        if s:
            assert abs(value(np.full(len(t), b)) - scores.max()) < 1e-6
    assert 0 < sure.sum() < len(texts)


def test_language_shortcut_minds_paths_that_avoid_the_best_total():
    example = np.array([[0.0, -8.0, -3.0]] * 3 + [[-8.0, 0.0, -3.0]] * 3)
    best, sure = op2_language.single_language(example, np.array([0]), 12.0)
    assert best.tolist() == [2] and not sure[0]
    assert op2_language.viterbi([example], 12.0)[0].tolist() == [0, 0, 0, 1, 1, 1]
    draw = np.random.default_rng(8)
    texts = [np.repeat(draw.choice([0.0, -1.0, -3.0, -8.0], size=(m, 3)), draw.integers(1, 5), axis=0) for m in draw.integers(1, 6, 3000)]
    first = np.append(0, np.cumsum([len(t) for t in texts])[:-1])
    best, sure = op2_language.single_language(np.concatenate(texts), first, 12.0)
    for t, b, s, p in zip(texts, best, sure, op2_language.viterbi(texts, 12.0), strict=True):
        top = t[np.arange(len(t)), p].sum() - 12.0 * (np.diff(p) != 0).sum()
        assert not s or abs(t[:, b].sum() - top) < 1e-6
    assert 0 < sure.sum() < len(texts)


def simhash(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, texts):
    rows = {r.doc_id: r for r in op3_simhash.op3_simhash(spark, SF).collect()}
    keys = sorted(texts)
    prints = np.array([simhash(texts[k]) for k in keys], np.uint64)
    assert [rows[k].fingerprint for k in keys] == [f"{int(f):016x}" for f in prints]
    labels = np.arange(len(keys))
    op3_simhash.join_labels(labels, *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3))
    assert [rows[k].component_id for k in keys] == [keys[i] for i in labels]


def test_keep_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (2, c), (None, d), (None, a), (3, None), (None, "")]
    kept = op3_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (None, b), (1, c), (1, d), (3, None)])


def test_trees_find_every_link(spark):
    draw = np.random.default_rng(1)
    near = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [near ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64)) for _ in range(6)]
    dense = np.uint64(12345) ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([near, *flips, dense]))
    labels = np.arange(len(fps))
    op3_simhash.join_labels(labels, *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(op3_simhash.link_edges(df, sample_size=200, shard=64)).collect()}
    groups = {}
    for f, lab in zip(fps.view(np.int64).tolist(), labels.tolist()):
        groups.setdefault(lab, set()).add(roots.get(f, f))
    sample = np.sort(near)
    for part in range(op3_simhash.PARTS):  # boundaries overlap, and triangle bounds prune
        tree = op3_simhash.build_tree(sample, part, len(sample), 64)
        routed = sum(len(rows) for _, rows in tree.route(sample, op3_simhash.halves_of(sample, part)))
        assert len(sample) < routed < len(sample) * len(tree.chunks)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_new_words_are_scored_together():
    draw = np.random.default_rng(6)
    words = ["".join(chr(c) for c in draw.choice([*range(97, 109), 0x430, 0x1F600 - 0x1000], n)) for n in draw.integers(1, 9, 400)]
    grams = sorted({f"^{w}$"[i : i + 3] for w in words[:200] for i in range(len(w))})
    table = draw.normal(-5, 2, (len(grams) + 1, 3)).astype(np.float32)
    scripts = {"latin": np.array([True, True, False]), "cyrillic": np.array([False, True, True])}
    calls = []

    class Counted(op2_language.LanguageModel):
        def logs(self, words):
            calls.append(len(words))
            return super().logs(words)

    model = Counted(["a", "b", "c"], {g: k for k, g in enumerate(grams)}, table, scripts, even=np.zeros(3, np.float32))
    labeller = op2_language.Labeller(model, 12.0)
    labeller.label([" ".join(words[:300]), None, " ".join(words[200:])])
    assert len(calls) == 1 and calls[0] == len(labeller.ids)
    for word, k in labeller.ids.items():
        total = sum(table[model.grams.get(f"^{word}$"[i : i + 3], -1)].astype(float) for i in range(len(word)))
        allowed = scripts.get(op2_language.script_of(word[0]))
        want = np.zeros(3) if allowed is None else np.where(allowed, np.maximum(total - total[allowed].max(), -8.0), -32.0)
        assert np.allclose(labeller.rows[k], want, atol=1e-3)


def test_routed_rows_grow_with_the_table():
    draw = np.random.default_rng(4)
    sample = np.sort(draw.integers(0, 1 << 63, 4000, dtype=np.uint64))
    routed = []
    for total in (50_000, 250_000, 5_000_000):
        trees = [op3_simhash.build_tree(sample, part, total, op3_simhash.shard_size(total)) for part in range(op3_simhash.PARTS)]
        routed.append(len(op3_simhash.blocks_of(sample, trees)[0]))
    assert max(routed) < 1.2 * min(routed)


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_links_in_a_shard_match_brute_force(most):
    draw = np.random.default_rng(5)
    fps = draw.integers(0, 1 << 63, 12, dtype=np.uint64)[draw.integers(0, 12, 500)]
    for _ in range(3):
        fps ^= np.uint64(1) << draw.integers(0, 64, len(fps)).astype(np.uint64)
    fps = np.unique(fps)
    for part in range(op3_simhash.PARTS):
        halves = op3_simhash.halves_of(fps, part)
        want, got = np.arange(len(fps)), np.arange(len(fps))
        near = (np.bitwise_count(fps[:, None] ^ fps) <= 3) & (np.bitwise_count(halves[:, None] ^ halves) <= 1)
        op3_simhash.join_labels(want, *np.nonzero(near))
        a, b = op3_simhash.links_in(fps, halves, most)
        op3_simhash.join_labels(got, np.searchsorted(fps, a), np.searchsorted(fps, b))
        assert (got == want).all()
        assert op3_simhash.links_in(fps[:1], halves[:1])[0].size == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 900)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(101)}) == 1 and len({roots[500 + i] for i in range(80)}) == 1 and 900 not in roots
    assert roots[0] != roots[500]


def compare(spark, module, sf=SF):
    for name, sql in module.ORACLE.items():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got = module.QUERIES[name](spark, sf)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall()
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)


def test_decontamination_matches_sql(spark):
    compare(spark, op4_decontaminate)


def test_decontamination_without_broadcast(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    a = op4_decontaminate.decontaminate(docs, items).drop("text_hash")
    b = op4_decontaminate.decontaminate(docs, items, broadcast_rows=0).drop("text_hash")
    assert Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_decontamination_of_short_items(spark):
    docs = spark.createDataFrame([(1, "one TWO three four"), (2, "two, three!"), (3, "Été two"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "two three"), ("b", "..."), ("c", None), ("d", "Two-Three"), ("e", "été")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in op4_decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (4, 2, ["a", "d"], True), 2: (2, 2, ["a", "d"], True), 3: (2, 0, [], False), 4: (0, 0, [], False)}
    assert [r.doc_id for r in op4_decontaminate.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [3, 4]


def test_line_dedup_matches_sql(spark):
    compare(spark, op5_lines)


def test_line_dedup_of_variants(spark):
    base = [f"tok{i}" for i in range(20)]
    lines = [" ".join(base)] + [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(20)] + ["quite another line of its own", "a b c", "a b c"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    assert {r.doc_id for r in op5_lines.dedup_lines(df).where("n_removed = 1").collect()} == want


def test_line_dedup_with_null_ids(spark):
    base = [f"tok{i}" for i in range(20)]
    variant = lambda k: " ".join([*base[:k], f"new{k}", *base[k + 1 :]])
    rows = [(None, variant(18)), (1, variant(19)), (2, variant(17)), (None, "a line that no other row has"), (None, variant(18) + "\nand one more of its own")]
    out = op5_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, ""), (1, variant(19)), (2, ""), (None, "a line that no other row has"), (None, "and one more of its own")]
    assert Counter((r.doc_id, r.text) for r in out) == Counter(want)


def test_pii_base_patterns(texts):
    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and op6_pii.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]

    hard = ["a@b.c@d.e", "a@b@c.d", "..x@y.z.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.4", "00001.2.3.4", "+1 2345678901 +12", "4111 1111-1111 1111", "ab@-.-", "1" * 50, "@", "+", "+1", "é@b.c"]
    for t in [*texts.values(), *hard]:
        assert op6_pii.base_spans(t) == plain(t)


def test_pii_field_adds_other_spellings(spark):
    rows = [(1, "please call (415) 555-2671 now"), (2, "card 4111/1111/1111/1111 ok"), (3, "mail joe [at] corp [dot] com."), (4, "in 1999 we sold 12 of 15.5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = op6_pii.find(df)
    got = {r.doc_id: [(s.kind, rows[r.doc_id - 1][1][s.start : s.end]) for s in r.spans] for r in found.collect()}
    assert got == {1: [("phone", "(415) 555-2671")], 2: [("card", "4111/1111/1111/1111")], 3: [("email", "joe [at] corp [dot] com")], 4: []}
    assert op6_pii.redact(df).orderBy("doc_id").first().text == "please call <phone> now"


def test_redaction_is_by_row(spark):
    rows = [(1, "mail a@b.co now"), (1, "ip 10.0.0.1 x"), (None, "mail c@d.org now"), (None, None), (2, ""), (3, "clean words"), (3, "é😀 a@b.co, +1 555 010 99 99; 4111 1111 1111 1111")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("spans", F.lit("s")).withColumn("kind", F.array(F.lit(1))).withColumn("doc_id", F.lit(None).cast("string"))
    out = op6_pii.redact(df)
    assert out.schema == df.schema
    got = sorted((str(r.id), r.text or "", r.spans, r.kind, r.doc_id) for r in out.collect())
    texts = {"1": ["ip <ip> x", "mail <email> now"], "2": [""], "3": ["clean words", "é😀 <email>, <phone>; <card>"], "None": ["", "mail <email> now"]}
    assert got == [(k, t, "s", [1], None) for k, ts in texts.items() for t in ts]
    assert op6_pii.redact(df.limit(0)).count() == 0 and out.where("text is null").count() == 1


def test_masked_spans_that_overlap():
    text = "0123456789"
    assert op6_pii.masked(text, [("card", 1, 4, True), ("phone", 3, 7, True), ("ip", 7, 8, True)]) == "0<card><ip>89"
    assert op6_pii.masked(text, [("phone", 2, 8, True), ("card", 3, 5, False)]) == "01<phone>89" and op6_pii.masked(text, []) == text


def test_pii_viterbi_takes_the_best_path():
    draw = np.random.default_rng(1)
    for _ in range(20):
        n = int(draw.integers(1, 6))
        e, change = draw.normal(size=(n, 5)), draw.normal(size=(5, 5))
        value = lambda path: sum(e[i, x] for i, x in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(5), repeat=n), key=value)
        assert tuple(op6_pii.viterbi([e], change)[0]) == best == tuple(op6_pii.viterbi([e], change, alone=0)[0])


def test_pii_time_is_linear():
    finder = op6_pii.Finder(op6_pii.train())
    texts = ["write to bob [at] " + "adot" * 300 + " [dot] o1 soon", "mail bob at " + "dot" * 300 + " dot 1 please", "xat" * 300 + "@", "call (415) 555-2671 now a@b.co " * 8000, "+1(" * 80_000, "a@" * 100_000, "x at y dot " * 20_000]
    for t in texts:
        begin = time.perf_counter()
        extra, taken = finder.spans([t])[0], op6_pii.merged(op6_pii.base_spans(t))
        assert sum(not op6_pii.overlaps(taken, a, b) and op6_pii.fits(k, t[a:b]) for k, a, b in extra) in (0, 8000)
        assert time.perf_counter() - begin < 5


def test_warc_matches_sql(spark):
    compare(spark, op7_warc)


def test_warc_rules(spark):
    h = {"date": "1", "content-type": "a", "etag": "x"}
    rows = [
        (1, "http://www.A.com/p/?b=2&a=1&utm_x=1#f", 10, 200, '"x"', "d1", h), (2, "https://a.com/p?a=1&b=2", 20, 304, 'W/"x"', None, {"date": "2", "content-type": "b"}),
        (3, "a.com/p?a=1&b=2", 30, 304, '"y"', None, {}), (4, "a.com/p?a=1&b=2", 10, 304, '"x"', None, None), (5, "a.com/p?a=1&b=2", 40, 304, None, "d1", {}), (6, None, 40, 304, None, None, {}), (7, "a.com/p?a=1&b=2", 41, 304, None, None, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>")
    for spans in (1, 3, 256):
        got = {r.record_id: (r.outcome, r.response_id) for r in op7_warc.resolve_revisits(df, spans).collect()}
        assert got == {2: ("resolved", 1), 3: ("etag_mismatch", 1), 4: ("no_response", None), 5: ("resolved", 1), 6: ("no_response", None), 7: ("unvalidated", 1)}
    merged = op7_warc.resolve_revisits(df).where("record_id = 2").first().headers
    assert merged == {"date": "2", "content-type": "a", "etag": "x"}
    assert op7_warc.resolve_revisits(df.where("false")).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = op8_toxicity.op8_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = [r.predicted == r.toxic for r in out]
    assert sum(hit) / len(hit) > 0.97
    assert sum(r.predicted for r in out if r.toxic) / sum(r.toxic for r in out) > 0.85


def test_toxicity_folding_and_exceptions(spark):
    assert op8_toxicity.fold("Stυpid 1d10t l0s\u200ber TRASH### Páthetic a55 10 7.5 idi0ts$$$ $cum") == " stupid idiot ioser trash pathetic ass idiots scum "
    model = op8_toxicity.ToxicModel({" idiot ": 4.0, " trash ": 4.0}, (op8_toxicity.fold("trash can"),))
    rows = [(1, "you 1d!0t"), (2, "you 1di0t"), (3, "the trash can"), (4, "trash and a trash can"), (5, None), (6, "")]
    got = {r.doc_id: r.n_matches for r in op8_toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[2] == 1 and got[3] == 0 and got[4] == 1 and got[5] == got[6] == 0


def test_toxicity_learns_exceptions(spark):
    toxic = [(i, f"you are a clown number{i} and more", 1) for i in range(40)]
    clean = [(100 + i, f"the clown fish swims near reef{i} today", 0) for i in range(4)] + [(200 + i, f"nothing of note happened on day{i}", 0) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in toxic + clean], "doc_id long, text string")
    model = op8_toxicity.train(docs, spark.createDataFrame([(i, t) for i, _, t in toxic + clean], "doc_id long, toxic int"))
    assert op8_toxicity.fold("clown fish") in model.exceptions
    new = spark.createDataFrame([(1, "a clown fish again"), (2, "such a clown again")], "doc_id long, text string")
    assert {r.doc_id: r.n_matches for r in op8_toxicity.score(new, model).collect()} == {1: 0, 2: 1}


def test_toxicity_matches_a_plain_search():
    draw = np.random.default_rng(6)
    model = op8_toxicity.ToxicModel({" bad ": 2.0, " wors": 3.0, " b": 1.0}, (" bad luck ", " no worse "))
    found = model.automaton()
    for _ in range(200):
        folded = f" {' '.join(draw.choice(['bad', 'luck', 'worse', 'worst', 'no', 'ok', 'b'], draw.integers(1, 12)))} "
        places = lambda p: [(i, i + len(p) - 1) for i in range(len(folded)) if folded.startswith(p, i)]  # noqa: B023, E731
        excused = [x for p in model.exceptions for x in places(p)]
        want = sorted((a, b, w) for p, w in model.weights.items() for a, b in places(p) if not any(x <= a and b <= y for x, y in excused))
        assert sorted(op8_toxicity.hits_of(found, folded)) == want


def test_quality_base_counts(spark, texts):
    for r in op9_quality.op9_quality(spark, SF).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, repeats = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeats += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_quality_trees_are_monotonic():
    draw = np.random.default_rng(5)
    x = draw.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + draw.normal(0, 0.2, 2000) < 0.6).astype(float)
    forest = op9_quality.fit_forest(x, y, [-1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], axis=1)
    m = forest.margin(grid)
    assert (np.diff(m) <= 1e-12).all() and m[0] > m[-1]
    assert ((forest.margin(x) > 0) == (y > 0.5)).mean() > 0.8


def test_licence_base_counts(spark, texts):
    for r in op10_licenses.op10_licenses(spark, SF).collect():
        w = WORD.findall(lower(texts[r.doc_id]))
        places, labels = [], set()
        for phrase, label in op10_licenses.PHRASES.items():
            q = phrase.split()
            for i in range(len(w) - len(q) + 1):
                if w[i : i + len(q)] == q:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(","))


def test_licence_gate_and_suppression(texts):
    scanner = op10_licenses.Scanner()
    notices = [
        "licensed under the apache license, version 2.0", "permission is hereby granted, free of charge, to any person obtaining a copy of it. copyright 2020 daniel stenberg",
        "https://www.gnu.org/licenses/gpl-3.0.html and gnu general public license version 3", "spdx-license-identifier: mit", "you may make and give away verbatim copies of the source form of the software without restriction",
    ]
    for text in [*notices, *map(op10_licenses.lower, texts.values())]:
        found = [(*m.span(), r.label or m[1], r.priority) for r in op10_licenses.rules() for m in r.pattern.finditer(text)]
        stands = []
        for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not any(s[0] <= d[0] and d[1] <= s[1] for s in stands):
                stands.append(d)
        assert [d[:4] for d in scanner.detections(text, {w for _, w in scanner.gate.iter(text)})] == sorted(stands)


def test_licence_rules():
    scanner = op10_licenses.Scanner()
    label = lambda t: scanner.scan(t)["labels"]
    assert len(op10_licenses.rules()) > 200
    assert label("Licensed under the Apache License, Version 2.0.") == "apache-2.0"
    assert label("Released under the MIT License.") == "mit"
    assert label("this is CC BY-SA 4.0 text") == "cc-by,cc-by-sa"
    assert label("submit licenses here") == ""
    assert label("GNU Lesser General Public License v3") == "gpl,lgpl-3.0"


def test_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, n in ((hard, 11), (hard.where("false"), 0)):
        assert op1_packing.pack(docs, TOKENIZER).select("doc_id", "start").where("start = 0").count() == n
        model = op2_language.train(docs)
        assert op2_language.identify(docs, model).count() == n
        assert op2_language.keep_identified(docs, model).count() <= n
        assert op3_simhash.near_duplicates(docs).count() == n
        assert op3_simhash.keep_one(docs).columns == docs.columns
        assert op4_decontaminate.decontaminate(docs, docs, item_col="doc_id").count() == n
        assert op5_lines.dedup_lines(docs).count() == n
        assert op6_pii.find(docs).count() == n
        assert op8_toxicity.score(docs, op8_toxicity.train(docs, labels)).count() == n
        assert op9_quality.judge(docs, op9_quality.train(docs, labels)).count() == n
        assert op10_licenses.scan(docs).count() == n
    kept = [r.doc_id for r in op3_simhash.keep_one(hard).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 7, 8] and None in kept


def test_line_dedup_of_hot_tokens(spark, monkeypatch):
    draw = np.random.default_rng(2)
    base = [f"tok{i}" for i in range(20)]
    lines = [" ".join(np.where(draw.random(20) < 0.12, [f"new{draw.integers(9)}" for _ in base], base)) for _ in range(150)] + [f"tok{i} tok{i + 1} of its own {i % 7}" for i in range(60)]
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(op5_lines, "HOT_LINES", 3)
    for parts, listed in ((8, 1000), (1000, 0)):
        monkeypatch.setattr(op5_lines, "PART_LINES", parts)
        monkeypatch.setattr(op5_lines, "LISTED_TOKENS", listed)
        assert {r.doc_id for r in op5_lines.dedup_lines(df).where("n_removed = 1").collect()} == want


def test_line_dedup_of_long_lines(spark):
    draw = np.random.default_rng(4)
    base = [f"tok{i}" for i in range(300)]
    lines = [" ".join(np.where(draw.random(300) < draw.random() * 0.3, [f"new{draw.integers(900)}" for _ in base], base)) for _ in range(60)]
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert 0 < len(want) < 60
    assert {r.doc_id for r in op5_lines.dedup_lines(df).where("n_removed = 1").collect()} == want


def test_line_dedup_sorts_numbers_without_nulls(spark):
    df = spark.createDataFrame([(1, "rare often often\nof ten often\nonce more often")], "id long, text string")
    lines = op5_lines.all_lines(df)
    out = op5_lines.described(lines, op5_lines.rarity_levels(lines), 80)
    assert not out.schema["prefix"].dataType.containsNull
    rows = {r.no: (r.n, list(r.prefix)) for r in out.collect()}
    assert {no: (n, len(p)) for no, (n, p) in rows.items()} == {0: (2, 1), 1: (3, 1), 2: (3, 1)}
    assert all(p[0] >> op5_lines.LEVEL_BIT == 0 for _, p in rows.values())
    assert {r.n for r in op5_lines.prefix_rows(out).where(F.col("token") < op5_lines.MAYBE_HOT).collect()} == {2, 3}


def test_line_dedup_compares_lengths_that_may_match(spark, monkeypatch):
    for percent in (50, 80, 100):
        rows = spark.range(1, 400).select("id", op5_lines.band_of(F.col("id"), percent).alias("band"), op5_lines.bands_for(F.col("id"), percent).alias("bands")).collect()
        band = {r.id: r.band for r in rows}
        assert all(band[m] in r.bands for r in rows for m in band if m * 100 >= r.id * percent and r.id * 100 >= m * percent)
        assert max(len(r.bands) for r in rows) <= 3
    draw = np.random.default_rng(6)
    lines = [" ".join(["tok", *(f"t{k}" for k in range(n)), f"own{draw.integers(4)}"]) for n in draw.permutation(np.repeat([2, 5, 9, 12, 20, 26, 45, 60, 75, 90, 110], 12))]
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(op5_lines, "HOT_LINES", 3)
    assert {r.doc_id for r in op5_lines.dedup_lines(df).where("n_removed = 1").collect()} == want


def test_line_dedup_with_repeated_ids(spark):
    rows = [(1, "a first line\nshared by all of them", "x"), (2, "one of two\nshared by all of them", "y"), (2, "two of two\n\tshared by all of them", "z"), (2, "one of two\nshared by all of them", "w"), (None, None, "v")]
    out = op5_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string")).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out) == Counter([(1, rows[0][1], 2, 0), (2, "one of two", 2, 1), (2, "two of two", 2, 1), (2, "", 2, 2), (None, None, 0, 0)])
    named = op5_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string"), n_lines="a", n_removed="b")
    assert {r.n_removed for r in named.collect()} == set("xyzwv") and named.columns[-2:] == ["a", "b"]


def sample(tokens) -> str:
    """A text that a parsed pattern matches: first branches, fewest repeats."""
    out = []
    for op, value in tokens:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            kind, v = value[0]
            out.append(chr(v if str(kind) == "LITERAL" else v[0]) if str(kind) in ("LITERAL", "RANGE") else "1")
        elif name == "BRANCH":
            out.append(sample(value[1][0]))
        elif name == "SUBPATTERN":
            out.append(sample(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out.append(sample(value[2]) * (value[0] or str(value[2][0][0]) == "ANY"))
        elif name == "ANY":
            out.append("x")
    return "".join(out)


@pytest.mark.parametrize(("before", "gap", "after"), [("", " ", ""), ("/*\n * ", "\n * ", "\n */"), ("# ", "\n#  ", "\n"), ("", "  ", "\t"), ("// ", "\r\n//\t", ""), ("> ", " \n\n> ", ""), ("\u3000", "\u00a0", "")])
def test_license_rules_find_wrapped_texts(before, gap, after):
    import re._parser as parser

    for rule in op10_licenses.rules():
        plain = sample(parser.parse(rule.pattern.pattern))
        assert rule.pattern.fullmatch(plain), rule
        apart = "" if rule.keyword in plain else ". " + rule.keyword.replace(" ", gap)  # the gate asks for a word beside some sentences
        text = before + plain.replace(" ", gap) + apart + after
        folded = op10_licenses.Folded(text)
        m = rule.pattern.search(folded.text)
        assert m and rule.keyword in folded.text, (rule, folded.text)
        assert text[folded.back(m.start()) : folded.back(m.end(), end=True)] == plain.replace(" ", gap)


def test_license_headers_that_wrap():
    scanner = op10_licenses.Scanner()
    for text, label in (("Licensed under the Apache\nLicense, Version 2.0", "apache-2.0"), ("except\n * in compliance\n * with the License; you may not use this file except in compliance\n * with the License", "apache-2.0"),
                        ("Permission is hereby granted,  free of charge, to\n# any person obtaining a copy", "mit"), ("GNU General Public License\n;; version 3", "gpl-3.0")):
        got = scanner.scan(text)
        assert label in got["labels"].split(","), text
        assert all(0 <= d["start"] < d["end"] <= len(text) for d in got["detections"])
    d = scanner.scan("xx Apache\n *   License, Version 2.0 yy")["detections"][0]
    assert "xx Apache\n *   License, Version 2.0 yy"[d["start"] : d["end"]] == "Apache\n *   License, Version 2.0"


def test_license_scans_stay_linear():
    took = []
    for unit in (" ", "\n", "\n * ", "a  ", "\t/", " /*"):
        for n in (100_000, 400_000):
            begin = time.perf_counter()
            op10_licenses.Scanner().scan(unit * (n // len(unit)) + " apache license")
            took.append(time.perf_counter() - begin)
    assert all(b < 12 * max(a, 0.05) for a, b in zip(took[::2], took[1::2], strict=True)), took
