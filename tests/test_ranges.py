"""Pages by ranges against plain slices."""

import random

from lodestone.sources.ranges import RangedTable


def test_pages_equal_slices(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else rng.randrange(40), k, f"v{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "hour int, id long, v string").repartition(5)
    t = RangedTable.write(df, str(tmp_path / "t"), "hour", "id", rows_per_range=90)
    want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert t.ranges().count() > 5
    for skip, limit in ((0, 100), (333, 7), (950, 100), (1000, 10), (5000, 1), (0, 0), (89, 200), (999, 1)):
        assert [tuple(r) for r in t.page(skip, limit).collect()] == want[skip : skip + limit]
    files = t.page(500, 20).inputFiles()
    assert 1 <= len({f.split("_range=")[1].split("/")[0] for f in files}) <= 2


def test_equal_keys_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", 2)], "k string, n int")
    t = RangedTable.write(df, str(tmp_path / "t"), "k", rows_per_range=10)
    assert [r.k for r in t.page(299, 5).collect()] == ["a", "b"]
    assert RangedTable.write(df.limit(0), str(tmp_path / "e"), "k").page(0).count() == 0


def test_ranges_dont_grow_with_the_table(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "id % 7 AS hour")
    t = RangedTable.write(df, str(tmp_path / "t"), "hour", "id", rows_per_range=2, most_small=8)
    want = sorted((k % 7, k) for k in range(500))
    assert 2 <= t.ranges().count() <= 8
    assert [(r.hour, r.id) for r in t.page(240, 90).collect()] == want[240:330]
