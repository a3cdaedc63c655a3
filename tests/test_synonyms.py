"""Synonyms found by values: exact on small sets, precision and recall on planted ones, and rows that can't count."""

import random

from lodestone.operators import synonyms as sy


def plant(rng, groups=12, noise=20):
    """Labels of the same quantity with other samples of its values and other spellings, and labels of their own."""
    rows, same = [], {}
    for g in range(groups):
        unit, values = rng.choice(["cm", "kg", "v", ""]), [str(rng.randrange(10**6)) for _ in range(300)]
        for k in range(3):
            label = f"q{g} name {k}"
            same[label] = g
            for v in rng.sample(values, 300 if k == 0 else 120):
                rows.append((label, f"{v}{rng.choice([' ', '  '])}{unit.upper() if k == 2 else unit}"))
    for n in range(noise):
        rows += [(f"noise {n}", str(rng.randrange(10**6))) for _ in range(200)] + [(f"noise {n}", "yes"), (f"noise {n}", "no"), (f"noise {n}", "n/a")]
    return rows, same


def test_planted_synonyms(spark):
    rng = random.Random(11)
    rows, same = plant(rng)
    df = spark.createDataFrame(rows, "label string, value string")
    known = spark.createDataFrame([(f"q{g} name 0", f"canon_{g}", 1.0) for g in range(12)], "label string, canonical string, confidence double")
    for size in (256, 64):
        got = {r.label: r.canonical for r in sy.discovered_synonyms(df, known, size=size).collect()}
        right = sum(got.get(label) == f"canon_{g}" for label, g in same.items() if not label.endswith("0"))
        assert right / 24 >= 0.95 and right / len(got) >= 0.95, (size, got)
    again = {r.label: r.canonical for r in sy.discovered_synonyms(df.repartition(7), known, size=64).collect()}
    assert again == got


def test_containment_is_exact_on_small_sets(spark):
    rng = random.Random(5)
    sets = {f"l{k}": {str(rng.randrange(60)) for _ in range(rng.randint(1, 70))} for k in range(25)}
    df = spark.createDataFrame([(label, v) for label, vs in sets.items() for v in vs for _ in range(2)] + [(None, "1"), ("l0", None), ("empty", "  ")], "label string, value string")
    for least, support in ((0.8, 3), (0.5, 1), (1.0, 2)):
        got = {(r.label, r.other): (r.shared, r.compared) for r in sy.label_containment(df, least, support).collect()}
        want = {(a, b): (len(x & y), len(x)) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) >= max(support, least * len(x) - 1e-9)}
        assert got == want and want


def test_unknown_labels_name_each_other_once(spark):
    rows = [(label, str(v)) for label in ("Zeta", "Alpha", "Mid") for v in range(30)]
    none = spark.createDataFrame([], "label string, canonical string, confidence double")
    assert {tuple(r) for r in sy.discovered_synonyms(spark.createDataFrame(rows, "label string, value string"), none).collect()} == {("Zeta", "alpha", 1.0), ("Mid", "alpha", 1.0)}
    assert sy.discovered_synonyms(spark.createDataFrame([], "label string, value string"), none).count() == 0
