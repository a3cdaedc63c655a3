"""SimHash near-duplicates: vantage-point trees shard the fingerprints; shards that overlap a boundary give exact pairs.

Two fingerprints within three bits differ in at most one bit of one of their halves. So there is a tree for each half, with
search radius one: by the triangle inequality a fingerprint near a boundary, and only such, goes to both sides. A region
that no vantage of the half divides is divided by the distance of all 64 bits, with radius three.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import durable, map_slices, table
from lodestone.llm.components import components

RADIUS = 3
PARTS = 2
#: Of links within ``RADIUS`` bits, one half has at most so many.
PART_RADIUS = RADIUS // PARTS
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[str | None], seed: int = 42, shingle: int = 3) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        before = len(hashes)
        if len(words) <= shingle:
            hashes += [digest(b" ".join(words), seed)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            hashes += [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
        sizes[k] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.array(hashes, np.uint64)
    n = sizes[full]
    first = np.append(0, np.cumsum(n)[:-1])
    # Bits are counted eight at a time in byte lanes, in blocks too short to overflow a lane.
    blocks = np.concatenate([np.arange(a, a + m, 255) for a, m in zip(first, n, strict=True)])
    begins = np.searchsorted(blocks, first)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, blocks).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), begins, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """Id and fingerprint of each row, with ``hashed`` also the hash of its text."""
    more = [T.StructField("text_hash", T.LongType())] if hashed else []
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), *more])
    carried = [F.xxhash64(text_col).alias("text_hash")] if hashed else []

    def make():
        return lambda part: part | {"fp": fingerprints(part["text"]).view(np.int64)}

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried), "text", make, schema)


@dataclass
class VantageTree:
    """Nodes (whole, vantage, bound, inside, outside); a negative child ``-1 - i`` is shard i.

    A point within ``bound`` of the vantage belongs inside. By the triangle inequality nothing within the radius of a
    point at distance d can be inside if d > bound + radius, nor outside if d <= bound - radius. ``whole`` nodes measure
    all 64 bits (radius three), the others the tree's half (radius one).
    """

    nodes: list[tuple[bool, int, int, int, int]] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)  # of each shard; a shard with several is compared in blocks
    root: int = -1

    def route(self, fps: np.ndarray, halves: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Shards that each point belongs to or overlaps: pairs of a shard and the positions of its points."""
        out, work = [], [(self.root, np.arange(len(fps)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-1 - node, rows))
                continue
            whole, vantage, bound, inside, outside = self.nodes[node]
            d, radius = distances(fps[rows], halves[rows], whole, vantage)
            work += [(inside, rows[d <= bound + radius]), (outside, rows[d > bound - radius])]
        return out


def distances(fps: np.ndarray, halves: np.ndarray, whole: bool, vantage: int) -> tuple[np.ndarray, int]:
    """Distances from a vantage and the search radius that holds for them."""
    apart = fps ^ np.uint64(vantage) if whole else halves ^ np.uint32(vantage)
    return np.bitwise_count(apart).astype(np.int64), RADIUS if whole else PART_RADIUS


def build_tree(sample: np.ndarray, part: int, total: int, shard: int) -> VantageTree:
    """A tree whose shards hold about ``shard`` points each, overlaps included, for ``total`` points like ``sample``.

    Where few sample points are left the tree goes on with drawn vantages and the middle distance. Where no vantage
    divides a dense region, its shard is cut into chunks that are compared block by block.
    """
    tree, draw = VantageTree(), np.random.default_rng(part + 1)
    scale = total / max(1, len(sample))

    def leaf(expected: float) -> int:
        tree.chunks.append(max(1, int(np.ceil(expected / shard))))
        return -len(tree.chunks)

    def best_of(fps, halves, whole):
        best = None
        for turn in range(8):
            pool = fps if whole else halves
            vantage = int(draw.choice(pool)) if turn % 2 else int(draw.integers(0, (1 << (64 if whole else 32)) - 1, dtype=np.uint64, endpoint=True))
            d, radius = distances(fps, halves, whole, vantage)
            for bound in {int(np.median(d)) - 1, int(np.median(d))}:
                shares = (np.mean(d <= bound + radius), np.mean(d > bound - radius))
                if best is None or max(shares) < max(best[3]):
                    best = (whole, vantage, bound, shares)
        return best

    def grow(fps: np.ndarray, expected: float, depth: int) -> int:
        if expected <= shard or depth >= 24:
            return leaf(expected)
        halves = halves_of(fps, part)
        if len(fps) >= 64:
            best = best_of(fps, halves, False)
            if max(best[3]) > 0.9:
                best = best_of(fps, halves, True)
                if max(best[3]) > 0.8:
                    return leaf(expected)
        elif depth < 16:
            best = (False, int(draw.integers(1 << 32)), 15 + depth % 2, (0.64, 0.64))
        else:
            return leaf(expected)
        whole, vantage, bound, shares = best
        at = len(tree.nodes)
        tree.nodes.append((False, 0, 0, 0, 0))
        d, radius = distances(fps, halves, whole, vantage)
        inside = grow(fps[d <= bound + radius], expected * shares[0], depth + 1)
        outside = grow(fps[d > bound - radius], expected * shares[1], depth + 1)
        tree.nodes[at] = (whole, vantage, bound, inside, outside)
        return at

    tree.root = grow(sample, len(sample) * scale, 0)
    return tree


def halves_of(fps: np.ndarray, part: int) -> np.ndarray:
    return (fps >> np.uint64(32 * part)).astype(np.uint32)


def blocks_of(fps: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the block, tree and fingerprint for every block that a fingerprint takes part in."""
    keys, which, values = [], [], []
    for part, tree in enumerate(trees):
        for shard, rows in tree.route(fps, halves_of(fps, part)):
            n, mine = tree.chunks[shard], fps[rows]
            chunk = (((mine * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
            for other in range(n):
                low, high = np.minimum(chunk, other), np.maximum(chunk, other)
                keys.append(((shard * PARTS + part) << 32) + (low << 16) + high)
                which.append(np.full(len(mine), part, np.int32))
                values.append(mine)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, which, values))


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of linked positions; a class is named by its first position."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def links_in(fps: np.ndarray, halves: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the classes that the links between ``fps`` make whose halves differ in one bit at most.

    Points are ordered by their halves; those of an equal half, and of that half with one bit turned, are looked up and
    compared, at most about ``most`` pairs at a time.
    """
    order = np.argsort(halves, kind="stable")
    fps = fps[order]
    values, first, sizes = np.unique(halves[order], return_index=True, return_counts=True)
    labels, rows = np.arange(len(fps)), np.arange(len(fps))
    owner = np.repeat(np.arange(len(values)), sizes)

    def compare(i: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        """Hold each point of ``i`` against ``n`` points from ``begin``."""
        done = np.append(0, np.cumsum(n))
        at = 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
            m = n[at:stop]
            left = np.repeat(i[at:stop], m)
            right = np.arange(done[at], done[stop]) + np.repeat(begin[at:stop] - done[at:stop], m)
            near = np.bitwise_count(fps[left] ^ fps[right]) <= RADIUS
            join_labels(labels, left[near], right[near])
            at = stop

    same = (first + sizes)[owner] - rows - 1
    some = np.flatnonzero(same)
    compare(rows[some], rows[some] + 1, same[some])
    for bit in range(64 // PARTS):
        # The value with the bit unset looks for the other, so each pair of values comes once.
        low = np.flatnonzero((values >> np.uint32(bit)) & np.uint32(1) == 0)
        turned = values[low] | np.uint32(1 << bit)
        place = np.minimum(np.searchsorted(values, turned), len(values) - 1)
        hit = values[place] == turned
        other = np.full(len(values), -1)
        other[low[hit]] = place[hit]
        some = np.flatnonzero(other[owner] >= 0)
        compare(rows[some], first[other[owner[some]]], sizes[other[owner[some]]])
    moved = np.flatnonzero(labels != rows)
    return fps[moved], fps[labels[moved]]


def shard_size(total: int, least: int = 4096, shards: int = 12) -> int:
    """Points that a shard should hold: a share of all, so that trees don't get deeper with the table."""
    return max(least, -(-total // shards))


def link_edges(distinct: DataFrame, sample_size: int = 20_000, shard: int = 4096, shards: int = 12) -> DataFrame:
    """Edges (a, b) of a forest over ``distinct(fp)`` whose components are those of all links within three bits.

    The trees are fitted on at most about ``sample_size`` fingerprints; every fingerprint is routed and compared. Each level
    of a tree doubles the points near its boundary, so the trees of a large table stop at shards of a ``shards``-th of it:
    the rows that are routed grow with the table, and a shard is searched by looking up halves, not by all of its pairs.
    """
    total = distinct.count()
    shard = shard_size(total, shard, shards)
    parts = 1_000_000
    share = min(parts, int(parts * sample_size / max(1, total)) + 1)
    sample = np.array([r.fp for r in distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(parts)) < share).limit(2 * sample_size).collect()], np.int64)
    sample = np.sort(sample).view(np.uint64)
    trees = [build_tree(sample, part, total, shard) for part in range(PARTS)]
    shared = distinct.sparkSession.sparkContext.broadcast(trees)
    placed = T.StructType([T.StructField("block", T.LongType()), T.StructField("tree", T.IntegerType()), T.StructField("fp", T.LongType())])

    def route(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                keys, which, values = blocks_of(fps[at : at + 2000], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(which, pa.int32()), pa.array(values.view(np.int64), pa.int64())], names=placed.names)

    def compare(group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy()).view(np.uint64)
        a, b = links_in(fps, halves_of(fps, group.column("tree")[0].as_py()))
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return distinct.select("fp").mapInArrow(route, placed).groupBy("block").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, fingerprint (16 hexadecimal digits) and component (smallest id in it).

    Equal fingerprints are one point, so copies cost one row each and no comparison. A null text counts as empty; texts
    without words have fingerprint zero and are linked like any other. A null id never names a component unless all of
    its ids are null. Repeated rows stay; an empty table gives no rows; columns besides the two named are not read.
    """
    prints = durable(fingerprint_table(docs, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(link_edges(distinct))
    linked = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    least = durable(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = roots.withColumnRenamed("node", "fp").join(least, "root").select("fp", "component_id")
    named = durable(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, then of the smallest hash of its text.

    So rows that share an id, or have none, stay if their components differ. Of rows with the same id and text one stays.
    """
    prints = fingerprint_table(docs, id_col, text_col, hashed=True)
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash")
    distinct = durable(prints.groupBy("fp").agg(F.min(first).alias("least")))
    roots = components(link_edges(distinct)).withColumnRenamed("node", "fp")
    heads = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    heads = heads.select(F.col("least.id").alias("__head_id"), F.col("least.text_hash").alias("__head_hash"))
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__head_id")) & (F.col("__text_hash") == F.col("__head_hash"))
    return hashed.join(heads, same, "left_semi").dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
