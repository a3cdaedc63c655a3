"""Hard-negative mining by slot-decomposed selection (queries ``op13_hard_negatives``).

The upper limits of an anchor's positives split scores into disjoint slots: slot j lies between the limits of positives
j + 1 and j. Tasks and their combiners keep the best few candidates of each slot; the best under the limit of positive j
are then the first of slots j, j + 1, ... in this order, so merges from the lowest slot upwards answer all windows, which
overlap, without looking at a candidate twice.

Anchors meet rows in a grid: packed blocks of anchors by packed chunks of rows, each pair of groups in one cell. A cell
holds its anchors and one chunk at a time; rows stream through it. Scores are exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import table

#: Anchors of one cell of the grid, about, and rows of one chunk.
BLOCK_ANCHORS, CHUNK_ROWS = 2048, 1024
#: Components beyond this are set to it, and scores beyond a long to the largest one.
MOST, LONG = 2**53, 2**63 - 1

_PACK = "dim int, ids binary, labels binary, keys binary, vectors binary, kind string, limits binary"
_BEST = "anchor_id long, anchor_key long, slot int, score long, id long"


def usable(rows: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """``id, label, vec, anchor_key`` of rows with an id, a label and a vector of finite components."""
    out = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))))
    return out.withColumn("anchor_key", F.xxhash64("label", "vec"))


def _narrow(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(initial=0)
    return m.astype(next(t for t in ("i1", "i2", "i4", "i8") if top <= np.iinfo(t).max))


def _repeated(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whether a row is like one that comes first; like ones must not take each other's places among the best."""
    order = np.lexsort((*vectors.T, labels, ids))
    same = (np.diff(ids[order]) == 0) & (np.diff(labels[order]) == 0) & (np.diff(vectors[order], axis=0) == 0).all(axis=1)
    out = np.zeros(len(ids), bool)
    out[order[1:]] = same
    return out


def packed(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows as records of up to ``size`` different vectors of one dimension, components as ``floor(scale * x)``."""
    limited = "limits" in rows.columns

    def run(batches):
        schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("keys", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("limits", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ids, labels, keys = (column[n].to_numpy(zero_copy_only=False).astype("i8") for n in ("id", "label", "anchor_key"))
            dims = np.diff(column["vec"].offsets.to_numpy())
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                flat = column["vec"].take(pa.array(of)).flatten().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(flat.reshape(len(of), dim) * scale), -MOST, MOST).astype("i8")
                limits = column["limits"].take(pa.array(of)).flatten().to_numpy().reshape(len(of), -1) if limited else None
                new = ~_repeated(ids[of], labels[of], whole)
                of, whole, limits = of[new], whole[new], limits[new] if limited else None
                for at in range(0, len(of), size):
                    part = of[at : at + size]
                    m = _narrow(whole[at : at + size])
                    record = [dim, ids[part].tobytes(), labels[part].tobytes(), keys[part].tobytes(), m.tobytes(), m.dtype.str, limits[at : at + size].tobytes() if limited else None]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(record, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, _PACK)


class _Pack:
    def __init__(self, r: dict):
        of = lambda b: np.frombuffer(b or b"", "i8")
        self.ids, self.labels, self.keys = of(r["ids"]), of(r["labels"]), of(r["keys"])
        self.m = np.frombuffer(r["vectors"], r["kind"]).reshape(len(self.ids), r["dim"]).astype("i8")
        self.top = int(np.abs(self.m).max(initial=0))
        self.limits = of(r["limits"]).reshape(len(self.ids), -1)


def inner_products(a: _Pack, b: _Pack) -> np.ndarray:
    """Exact scores: doubles while every sum fits their 53 bits, or else integers of any size, set to the range of a long."""
    if a.top * b.top * max(1, a.m.shape[1]) < 2**53:
        return (a.m.astype("f8") @ b.m.astype("f8").T).astype("i8")
    exact = a.m.astype(object) @ b.m.astype(object).T
    return np.clip(exact, -LONG, LONG).astype("i8")


def best(group: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each group by score and then smaller id; the same candidate counts once."""
    order = np.lexsort((id, -score, group))
    group, score, id = group[order], score[order], id[order]
    new = np.ones(len(group), bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(score) != 0) | (np.diff(id) != 0)
    group, score, id = group[new], score[new], id[new]
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0][: len(group)])
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    kept = rank < k
    return group[kept], score[kept], id[kept]


class _Cell:
    """One block of anchors and the best candidates of each of its slots so far."""

    def __init__(self, anchors: _Pack, k: int, slots: int):
        self.anchors, self.k, self.slots = anchors, k, slots
        self.kept = tuple(np.empty(0, "i8") for _ in range(3))

    def positives(self, rows: _Pack) -> None:
        a, s = self.anchors, inner_products(self.anchors, rows)
        ok = (a.labels[:, None] == rows.labels) & (a.ids[:, None] != rows.ids)
        if s.shape[1] > self.k:
            at = s.shape[1] - self.k
            ok &= s >= np.partition(np.where(ok, s, -LONG), at, axis=1)[:, at, None]
        r, c = np.nonzero(ok)
        self._merge(r, s[r, c], rows.ids[c])

    def negatives(self, rows: _Pack) -> None:
        a, s = self.anchors, inner_products(self.anchors, rows)
        low, high = a.limits[:, : self.slots], a.limits[:, self.slots :]
        other = (a.labels[:, None] != rows.labels) & (a.ids[:, None] != rows.ids)
        r, c = np.nonzero((s <= high[:, :1]) & (s >= low.min(axis=1)[:, None]) & other)
        s = s[r, c]
        slot = (s[:, None] <= high[r]).sum(axis=1) - 1
        ok = s >= low[r, slot]
        self._merge((r * self.slots + slot)[ok], s[ok], rows.ids[c[ok]])

    def _merge(self, group, score, id) -> None:
        if len(group):
            self.kept = best(*(np.concatenate(x) for x in zip(self.kept, (group.astype("i8"), score, id), strict=True)), self.k)

    def rows(self) -> list[np.ndarray]:
        group, score, id = self.kept
        of = group // self.slots
        return [self.anchors.ids[of], self.anchors.keys[of], (group % self.slots).astype("i4"), score, id]


def grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, method: str, k: int, slots: int) -> DataFrame:
    """Candidates ``anchor_id, anchor_key, slot, score, id`` that each cell of the grid keeps.

    There are about as many cells as shuffle partitions, more only where anchors fill more blocks, so what cells keep
    grows with the anchors and not with the product of both tables.
    """
    spark = rows.sparkSession
    n_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    n_groups = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))
    mine = F.pmod(F.xxhash64("ids", "keys"), F.lit(n_blocks))
    blocks = anchors.select("*", mine.cast("int").alias("block"), F.lit(0).alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"))
    part = F.pmod(F.xxhash64("ids", "keys"), F.lit(n_groups)).cast("int")
    chunks = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("turn"), part.alias("part"))
    cells = blocks.unionByName(chunks).repartition("block", "part").sortWithinPartitions("block", "part", "turn")

    def run(batches):
        cell, held = None, []
        schema = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

        def out():
            for x in held:
                if len(x.kept[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in x.rows()], schema=schema)

        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                if (r["block"], r["part"]) != cell:
                    yield from out()
                    cell, held = (r["block"], r["part"]), []
                pack = _Pack(r)
                if r["turn"] == 0:
                    held.append(_Cell(pack, k, slots))
                else:
                    for x in held:
                        if x.anchors.m.shape[1] == pack.m.shape[1]:
                            getattr(x, method)(pack)
        yield from out()

    return cells.mapInArrow(run, _BEST)


def _first(k: int) -> Column:
    """Of the candidates of a group, each once, the first ``k`` as ``struct<minus, id>``."""
    return F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k)


def _floor_share(score: Column, percent: int) -> Column:
    """``floor(percent * score / 100)`` without passing a long."""
    return F.floor(score.cast("decimal(20,0)") * F.lit(percent) / F.lit(100)).cast("long")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, id: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors and their positives.

    The score of two rows is the inner product of their components, each ``floor(scale * x)``. An anchor's positives are
    its first rows of the same label and another id; a positive's negatives are the first of another label and id whose score
    is ``low`` to ``high`` percent of its own. Higher scores come first, ties by smaller id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Copies of a row under one
    id count once, as candidates and as anchors; different rows under one id each count. Vectors of other lengths than the
    anchor's are no candidates. Components are limited to ±2^53 and scores to a long. Labels are whole numbers. Columns
    besides the three named are not read; an empty table gives no rows.
    """
    good = usable(rows, id, label, vector)
    anchors = usable(rows.where(is_anchor), id, label, vector).dropDuplicates(["id", "anchor_key"])
    n_anchors = anchors.count()
    chunks = packed(good, scale, CHUNK_ROWS)
    found = grid(packed(anchors, scale, BLOCK_ANCHORS), chunks, n_anchors, "positives", positives, 1)
    top = found.groupBy("anchor_id", "anchor_key").agg(_first(positives).alias("best"))
    top = top.select("anchor_id", "anchor_key", F.transform("best", lambda b: F.struct(b["id"].alias("id"), (-b["minus"]).alias("score"))).alias("positives"))
    # Behind the last positive there are no slots: limits that no score lies between.
    rest = F.lit(positives) - F.size("positives")
    limits = lambda f, beyond: F.concat(F.transform("positives", lambda p: f(p["score"])), F.array_repeat(F.lit(beyond), rest))
    lows, highs = limits(lambda s: -_floor_share(-s, low), LONG), limits(lambda s: _floor_share(s, high), -LONG)
    keyed = anchors.withColumnRenamed("id", "anchor_id").join(top, ["anchor_id", "anchor_key"])
    limited = keyed.select(F.col("anchor_id").alias("id"), "label", "vec", "anchor_key", F.concat(lows, highs).alias("limits"))
    found = grid(packed(limited, scale, BLOCK_ANCHORS), chunks, n_anchors, "negatives", negatives, positives)
    slots = found.groupBy("anchor_id", "anchor_key", "slot").agg(_first(negatives).alias("best"))
    slots = slots.groupBy("anchor_id", "anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    both = top.join(slots, ["anchor_id", "anchor_key"])
    none = F.array().cast("array<struct<minus:long,id:long>>")
    at = lambda j: F.coalesce(F.try_element_at("slots", j), none)
    merged = F.aggregate(
        F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), F.array().cast("array<array<struct<minus:long,id:long>>>"),
        lambda acc, j: F.concat(F.array(F.slice(F.concat(at(j), F.coalesce(F.get(acc, F.lit(0)), none)), 1, negatives)), acc),
    )
    windows = both.select("anchor_id", F.posexplode("positives").alias("j", "p"), merged.alias("merged")).withColumn("under", F.get("merged", F.col("j")))
    inside = F.filter("under", lambda n: -n["minus"] >= -_floor_share(-F.col("p.score"), low))
    out = windows.select("anchor_id", "p", F.posexplode(inside).alias("rank", "n"))
    return out.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"),
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


_SQL = """WITH good AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 pairs AS (SELECT a.id AS anchor_id, a.label = r.label AS same, r.id AS id, CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score FROM good a JOIN good r ON a.id % 50 = 0 AND a.id <> r.id),
 pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": _SQL}
