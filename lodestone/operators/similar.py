"""Similar values by the exact matching-blocks ratio, without comparing all pairs of an attribute.

The ratio of two texts is twice the length of their matching blocks over both lengths. Blocks that match form a common
subsequence, so a ratio of ``t`` bounds how many characters either text has beside it, and with that how many of its
q-grams can fail to be in the other text. Two texts with enough q-grams in common share one among the rarest of each
(prefix filter); only such pairs are looked at, under bounds on lengths and on what can still match behind the shared
q-gram, then on edits, and what is left is scored exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import maybe_similar
from lodestone.operators.model_hook import similarity_ratio
from lodestone.storage import written

#: Hash buckets of q-grams whose counts give their order: their number bounds what is broadcast.
BUCKETS = 1 << 16
#: Against rounding of products with the threshold.
EPS = 1e-9


def _least_common(q: int, a: Column | int, b: Column | int, threshold: float, ceil) -> Column | int:
    """How many q-grams of a text of length ``a`` a similar text of length ``b`` has at least, each occurrence counting."""
    blocks = ceil((a + b) * (threshold / 2) - EPS)
    return (a - q + 1) - (a * q + b * (q - 1) - blocks * (2 * q - 1))


def gram_size(threshold: float) -> int:
    """The longest q-grams, up to 3, of which similar texts surely share one, whatever their lengths."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be in (0, 1]")
    far = (2 - threshold) / threshold
    for q in (3, 2):
        short = [
            _least_common(q, a, b, threshold, math.ceil) for a in range(1, 80) for b in range(1, 80)
            if (a, b) != (1, 1) and 2 * min(a, b) >= threshold * (a + b) - EPS and (a + b) * (1 - threshold) >= 1 - EPS
        ]
        slopes = [1 - q - r * (q - 1) + (1 + r) * (threshold / 2) * (2 * q - 1) for r in (1 / far, far)]
        if min(short, default=1) >= 1 and min(slopes) > 0:
            return q
    return 1


def candidate_pairs(values: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``group, a, b`` (a before b) of different values of a group whose ratio may reach ``threshold``, each pair once.

    ``values(group, low)`` has different texts of each group; null texts have no pairs. Work goes by the rarest q-grams: a
    group of any size is dealt out by them, and no list of its values is built. The values are written down once, since they are
    read several times.
    """
    q = gram_size(threshold)
    # Texts so short that one edit is too much are similar to none but themselves.
    v = written(values.select("group", "low", F.length("low").alias("n"), F.md5("low").alias("id")).where((F.col("n") * 2 + 1) * (1 - threshold) >= 1 - 2 * EPS))
    at = F.sequence(F.lit(1), F.greatest(F.col("n") - (q - 1), F.lit(1)))
    v = v.withColumn("plain", F.array_sort(F.transform(at, lambda i: F.substring("low", i, q))))
    # Each q-gram with the number of its occurrence in the text, so that repeated ones count as often as they match.
    v = v.withColumn("grams", F.transform("plain", lambda g, i: F.concat((i - F.array_position("plain", g)).cast("string"), F.lit(":"), g)))
    bucket = lambda g: F.pmod(F.xxhash64("group", g), F.lit(BUCKETS)).cast("int")
    rows = v.select("group", "id", "n", F.explode("grams").alias("gram"))
    counts = rows.groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("times"))
    ranked = rows.withColumn("bucket", bucket(F.col("gram"))).join(F.broadcast(counts), "bucket")
    # The most q-grams that a text can lose to a similar one, at the ends of the range of its lengths.
    n = F.col("n")
    lost = lambda b: n * q + b * (q - 1) - (n + b) * (threshold / 2 * (2 * q - 1))
    most = F.floor(F.greatest(lost(n * (threshold / (2 - threshold))), lost(n * ((2 - threshold) / threshold))) + EPS) + 1
    prefixes = ranked.groupBy("group", "id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("all"))
    prefixes = prefixes.select("group", "id", "n", F.posexplode(F.slice("all", F.lit(1), most.cast("int"))).alias("rank", "g"))
    side = lambda s: prefixes.select("group", F.col("g.gram").alias("gram"), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "rank")])
    na, nb = F.col("n_a"), F.col("n_b")
    least = F.greatest(_least_common(q, na, nb, threshold, F.ceil), _least_common(q, nb, na, threshold, F.ceil), F.lit(1))
    behind = 1 + F.least(na - q - F.col("rank_a"), nb - q - F.col("rank_b"))
    fits = (F.col("id_a") < F.col("id_b")) & (2 * F.least(na, nb) >= (na + nb) * F.lit(threshold) - EPS) & (behind >= least)
    pairs = side("a").join(side("b"), ["group", "gram"]).where(fits).select("group", "id_a", "id_b").distinct()
    text = lambda s: v.select("group", F.col("id").alias(f"id_{s}"), F.col("low").alias(s))
    both = pairs.join(text("a"), ["group", "id_a"]).join(text("b"), ["group", "id_b"]).where(maybe_similar(F.col("a"), F.col("b"), threshold))
    return both.select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(values: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``group, a, b`` (a before b) of the different values ``values(group, low)`` whose ratio (a, b) reaches ``threshold``."""
    return candidate_pairs(values, threshold).where(similarity_ratio(F.col("a"), F.col("b")) >= threshold)


def first_independent(edges: DataFrame) -> DataFrame:
    """``group, node`` of nodes that go when nodes are taken in order and one goes if an earlier one that stays has an edge
    to it. ``edges(group, before, after)`` lead from earlier to later nodes.

    In each round the nodes without an edge from before stay and those after them go. There are as many rounds as steps in
    the longest chain of decisions, half the longest path at most; rounds are written down in the shared folder, so that a
    lost executor costs a reread.
    """
    edges = written(edges.select("group", "before", "after").where("before <> after").distinct())
    gone = edges.select("group", F.col("after").alias("node")).limit(0)
    while not edges.isEmpty():
        stay = edges.select("group", "before").distinct().join(edges.select("group", F.col("after").alias("before")).distinct(), ["group", "before"], "left_anti")
        went = written(edges.join(stay, ["group", "before"]).select("group", F.col("after").alias("node")).distinct())
        gone = gone.unionByName(went)
        for side in ("before", "after"):
            edges = edges.join(went.withColumnRenamed("node", side), ["group", side], "left_anti")
        edges = written(edges)
    return gone
