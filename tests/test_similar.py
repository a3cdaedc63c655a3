"""Similar values (D2) and the fold over them (D3) against plain loops with the exact ratio."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.operators import similar, standardize as st


def near(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and out:
            del out[min(k, len(out) - 1)]
        else:
            out.insert(k, rng.choice("ab 7é"))
    return "".join(out)


def texts(rng, n):
    stems = ["".join(rng.choice("abc 12é") for _ in range(rng.randint(1, 40))) for _ in range(n // 6)] + ["a" * k for k in (5, 10, 11, 12, 30)] + ["ab" * 9, "abc" * 12]
    return sorted({near(rng, rng.choice(stems)) for _ in range(n)})


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.6])
def test_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(3)
    groups = {g: texts(rng, 260) for g in ("x", "y")}
    rows = [(g, t) for g, ts in groups.items() for t in ts] + [("x", None), (None, "abcabcabcabc"), (None, "abcabcabcabd")]
    got = {tuple(r) for r in similar.similar_pairs(spark.createDataFrame(rows, "group string, low string"), threshold).collect() if r.group}
    want = {(g, a, b) for g, ts in groups.items() for a in ts for b in ts if a < b and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.3])
def test_gram_size_is_safe(threshold):
    q = similar.gram_size(threshold)
    for a in range(1, 130):
        for b in range(a, 130):
            if b > a and 2 * a >= threshold * (a + b) and (a + b) * (1 - threshold) >= 1:
                for x, y in ((a, b), (b, a)):
                    assert similar._least_common(q, x, y, threshold, lambda v: -int(-v // 1)) >= 1, (q, a, b)


def test_no_key_holds_an_attribute(spark):
    plan = similar.candidate_pairs(spark.createDataFrame([("g", "x")], "group string, low string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    joins = [line for line in plan.splitlines() if "Join" in line and "gram" in line]
    assert joins and all("group" in line for line in joins)


def fold(values, threshold=0.9):
    kept = []
    for v in values:
        if v and not any(SequenceMatcher(None, v, seen).ratio() >= threshold for seen in kept):
            kept.append(v)
    return kept


def test_long_lists_equal_the_plain_fold(spark):
    rng = random.Random(8)
    lists = {k: [" ".join(t.split()) for t in rng.sample(texts(rng, 90), 60)] for k in range(6)}
    lists[6] = ["x" * k for k in range(1, 61)]  # a chain: each is similar to the next
    lists[7], lists[8], lists[9] = ["", ""], ["black"], ["a b", "A  B", "a b"] * 30
    rows = [(k, "a", i, v, "web") for k, vs in lists.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "product_key long, attribute string, pos long, value string, source string")
    by_joins, by_arrays = ({r.product_key: [x.value for x in r.vals or []] for r in st.dissimilar_lists(df, longest=n).collect()} for n in (2, 1000))
    want = {k: fold([v for j, v in enumerate(vs) if v.lower() not in [x.lower() for x in vs[:j]]]) for k, vs in lists.items()}
    want[9] = ["a b"]
    assert by_joins == want and by_arrays == want


def test_independent_set(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}
    gone = {r.node for r in similar.first_independent(spark.createDataFrame([("g", a, b) for a, b in edges], "group string, before long, after long")).collect()}
    want = set()
    for n in range(60):
        if any(b == n and a not in want for a, b in edges):
            want.add(n)
    assert gone == want
    assert similar.first_independent(spark.createDataFrame([], "group string, before long, after long")).count() == 0


def test_nulls_and_empty_tables(spark):
    schema = "product_key long, attribute string, pos long, value string, source string"
    assert st.dissimilar_lists(spark.createDataFrame([], schema)).count() == 0
    assert st.similar_values(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, None), (1, "a", None, "some value 1", None), (1, "a", None, "some value 12", None), (1, "a", 0, None, "web")]
    got = {r.product_key: r.vals and [x.value for x in r.vals] for r in st.dissimilar_lists(spark.createDataFrame(rows, schema).withColumn("low", F.lit("x")), longest=1).collect()}
    assert got == {None: None, 1: ["some value 1"]}
