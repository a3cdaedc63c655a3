"""Tables in buckets: what a change touches, repeated and null keys, versions, and rules for patches."""

from pyspark.sql import functions as F

from lodestone.operators import catalog as ct
from lodestone.operators import enrich, golden
from lodestone.sources.keyed import KeyedTable, one_per_key


def rows(spark, values):
    return spark.createDataFrame(values, "id long, name string, size int")


def table(spark, tmp_path, n=200, buckets=16):
    start = rows(spark, [(i, f"n{i}", i) for i in range(n)] + [(None, "null", -1)])
    t = KeyedTable(spark, str(tmp_path / "t"), "id", start.schema, buckets)
    t.update(start, lambda old, new: old.unionByName(new))
    return t


def content(t, as_of=None):
    return {r.id: (r.name, r.size) for r in t.read(as_of).collect()}


def test_a_small_change_touches_few_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    before, manifest = content(t), t.manifest()
    touched = t.update(rows(spark, [(3, "x", None), (4, None, 9)]), lambda old, new: ct.patch_rows(old, new, "id"))
    assert 1 <= len(touched) <= 2 and t.version() == 1
    assert {b for b, v in t.manifest().items() if v != manifest[b]} == touched
    read = {f.split("bucket=")[1].split("/")[0] for f in t.of_keys(rows(spark, [(3, "", 0)])).inputFiles()}
    assert len(read) == 1
    assert content(t) == before | {3: ("x", 3), 4: ("n4", 9)} and content(t, 0) == before
    assert [r.name for r in t.get(3).collect()] == ["x"] and [r.name for r in t.get(None).collect()] == ["null"] and t.get(999).count() == 0


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    before = content(t)
    delete = lambda old, new: ct.delete_rows(old, new, "id")
    t.update(rows(spark, [(k, None, None) for k in range(100)]), delete, version=5)
    t.update(rows(spark, [(7, None, None)]), delete, version=5)  # a version that was begun before is done anew
    assert content(t) == {k: v for k, v in before.items() if k != 7} and content(t, 4) == before
    assert t.update(rows(spark, []), delete) == set() and t.version() == 5
    after = content(t)
    assert t.vacuum() >= 2 and content(t) == after and t.vacuum() == 0
    t.update(t.read(), delete, version=6)
    assert content(t) == {None: before[None]}  # null is no key that an anti join finds
    t.update(rows(spark, [(1, "new", 1)]), lambda old, new: ct.sync_rows(old, new, "id"))
    assert content(t) == {None: before[None], 1: ("new", 1)}


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    t = table(spark, tmp_path)
    before = content(t)
    try:
        t.update(rows(spark, [(1, "x", 1)]), lambda old, new: rows(spark, [(k, "y", 0) for k in range(50)]))
    except ValueError:
        assert content(t) == before
    else:
        raise AssertionError


def test_one_row_for_each_key(spark):
    got = one_per_key(rows(spark, [(1, "a", 5), (1, "b", 3), (2, None, None), (2, None, None), (None, "x", 1), (None, "y", None)]), "id", ["size"])
    assert {tuple(r) for r in got.collect()} == {(1, "a", 5), (2, None, None), (None, "x", 1)}


def test_patches(spark):
    current = rows(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3)])
    schema = "id long, name string, size int, said array<string>, turn int"
    patches = spark.createDataFrame([(1, None, 9, ["name"], 1), (2, "x", None, None, 1), (2, "w", 7, None, 2), (3, None, None, ["size", "name"], 1), (3, "again", None, ["name"], 2), (8, "none", 1, None, 1)], schema)
    assert {tuple(r) for r in ct.patch_rows(current, patches, "id", "said", ["turn"]).collect()} == {(1, None, 1), (2, "w", 7), (3, "again", None)}
    assert {tuple(r) for r in ct.patch_rows(current, rows(spark, [(1, "p", None), (1, "q", None), (2, None, None)]), "id").collect()} == {(1, "q", 1), (2, "b", 2), (3, "c", 3)}
    assert ct.patch_rows(current, rows(spark, []), "id").count() == 3


def test_repeated_rows_of_upserts(spark):
    assert {tuple(r) for r in ct.sync_rows(rows(spark, [(1, "a", 1)]), rows(spark, [(1, "x", 1), (1, "y", 2), (5, "n", None)]), "id", ["size"]).collect()} == {(1, "y", 2), (5, "n", None)}
    enrichments = spark.createDataFrame([(1, "old")], "product_id long, seo_title string")
    products = spark.createDataFrame([(1, "pending"), (2, "pending")], "product_id long, enrichment_status string")
    out, done = enrich.upsert_enrichment(enrichments, spark.createDataFrame([(1, "b"), (1, "a")], "product_id long, seo_title string"), products)
    assert [tuple(r) for r in out.collect()] == [(1, "b")] and {tuple(r) for r in done.collect()} == {(1, "completed"), (2, "pending")}
    stock = spark.createDataFrame([], "product_code string, product_name string, brand_name string, enrichment_status string, completeness_score int")
    found = spark.createDataFrame([("p", "t1", "b", 3), ("p", "t2", "b", 3), ("p", "t2", "b", 3)], "product_code string, title string, brand string, n_attributes int")
    assert [(r.product_code, r.product_name) for r in golden.upsert_product(stock, found).collect()] == [("p", "t2")]


def test_a_patch_plan_reads_its_buckets(spark, tmp_path):
    t = table(spark, tmp_path, 500, 32)
    assert len(t.of_keys(rows(spark, [(1, "", 0)])).inputFiles()) < len(t.read().inputFiles()) / 8
    assert t.read(only=set()).count() == 0 and t.read().where(F.col("id") == 1).count() == 1


def test_aggregates_read_changed_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    how = ({"n": F.count("*"), "s": F.sum("size"), "sketch": F.hll_sketch_agg("name")}, {"n": F.sum("n"), "s": F.sum("s"), "names": F.hll_sketch_estimate(F.hll_union_agg("sketch"))})
    states = lambda: spark.read.parquet(f"{tmp_path}/t/states/all").count()
    assert tuple(t.aggregate("all", *how).first()) == (201, sum(range(200)) - 1, 201)
    before = states()
    assert tuple(t.aggregate("all", *how).first()) == (201, sum(range(200)) - 1, 201) and states() == before
    touched = t.update(rows(spark, [(3, "n4", 1003)]), lambda old, new: ct.patch_rows(old, new, "id"))
    assert tuple(t.aggregate("all", *how).first()) == (201, sum(range(200)) + 999, 200) and states() == before + len(touched)
    t.update(t.read(), lambda old, new: old.where("id is null"))
    assert tuple(t.aggregate("all", *how).first())[:2] == (1, -1)
    by = t.aggregate("by size", {"n": F.count("*")}, {"n": F.sum("n")}, ("size",))
    assert [tuple(r) for r in by.collect()] == [(-1, 1)]
    empty = KeyedTable(spark, str(tmp_path / "none"), "id", t.schema)
    assert tuple(empty.aggregate("all", *how).first())[0] is None
