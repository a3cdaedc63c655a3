"""Standardization: similar values, numeric clusters, conflicts, business rules and review routing.

The values of a product's attribute are folded in order, which is the operator's meaning. Equal values are merged by an
aggregate first, so an array holds the different values of one attribute of one product, not its observations; values of
attributes with many are folded by joins instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_value, edit_similar, number_and_unit, source_confidence
from lodestone.operators.model_hook import dissimilar_positions, similarity_ratio
from lodestone.operators.similar import candidate_pairs, first_independent, similar_pairs
from lodestone.schemas import REVIEW_BELOW
from lodestone.storage import written

_KEYS = ["product_key", "attribute"]


def first_values(observations: DataFrame) -> DataFrame:
    """``product_key, attribute, low, item``: the different cleaned values of an attribute, each at its first position."""
    low = F.lower(clean_value(F.col("value")))
    cleaned = observations.withColumn("low", F.nullif(low, F.lit(""))).withColumn("value", clean_value(F.col("value")))
    first = cleaned.groupBy(*_KEYS, "low").agg(F.min(F.struct("pos", "value", "source")).alias("v"))
    item = F.struct(
        F.col("v.pos").alias("pos"), F.col("v.value").alias("value"), "low", F.col("v.source").alias("source"),
        source_confidence(F.col("v.source")).alias("conf"), number_and_unit(F.col("v.value"))["number"].alias("number"),
    )
    return first.select(*_KEYS, "low", F.when(F.col("low").isNotNull(), item).alias("item"))


def _listed(first: DataFrame) -> DataFrame:
    lists = first.groupBy(*_KEYS).agg(F.array_sort(F.collect_list("item")).alias("vals"))
    return lists.select(*_KEYS, F.when(F.size("vals") > 0, F.col("vals")).alias("vals"), (F.size("vals") == 0).alias("blank"))


def value_lists(observations: DataFrame) -> DataFrame:
    """``product_key, attribute, vals``: different cleaned values by first position, null where all are empty."""
    return _listed(first_values(observations)).drop("blank")


def dissimilar_lists(observations: DataFrame, threshold: float = 0.9, longest: int = 128) -> DataFrame:
    """D3: ``product_key, attribute, vals`` with the values that stay: in order, one goes if it is similar to one that stayed."""
    return marked_lists(observations, threshold, longest).drop("blank")


def marked_lists(observations: DataFrame, threshold: float = 0.9, longest: int = 128) -> DataFrame:
    """``dissimilar_lists`` with ``blank``: whether all values are empty, known before the fold, so that a filter on it needs no fold.

    Lists of up to ``longest`` different values are folded in arrays. The values of longer ones are never gathered: their
    similar pairs are found by rare q-grams, and rounds of joins take out what goes. The different values are written down
    once; equal values count for their first position.
    """
    first = written(first_values(observations))
    sizes = first.groupBy(*_KEYS).agg(F.count("low").alias("size")).where(F.col("size") > longest).select(*_KEYS)
    if sizes.isEmpty():
        return _listed(first).withColumn("vals", keep_dissimilar("vals", threshold))
    sizes = written(sizes)
    short = _listed(first.join(sizes, _KEYS, "left_anti")).withColumn("vals", keep_dissimilar("vals", threshold))
    long = first.join(sizes, _KEYS, "left_semi").where("low is not null").select(F.struct(*_KEYS).alias("group"), "low", "item")
    place = lambda s: long.select("group", F.col("low").alias(s), F.struct("item.pos", "item.value").alias(f"at_{s}"))
    pairs = candidate_pairs(long, threshold).join(place("a"), ["group", "a"]).join(place("b"), ["group", "b"])
    before, after = (F.when((F.col("at_a") < F.col("at_b")) == early, F.col("a")).otherwise(F.col("b")) for early in (True, False))
    edges = pairs.select("group", before.alias("before"), after.alias("after"))
    gone = first_independent(edges.where(similarity_ratio(F.col("after"), F.col("before")) >= threshold))
    kept = long.join(gone.withColumnRenamed("node", "low"), ["group", "low"], "left_anti")
    return short.unionByName(_listed(kept.select("group.*", "low", "item")))


def keep_dissimilar(vals: str, threshold: float = 0.9, method: str = "ratio") -> Column:
    """D3: in order, a value stays if it is similar to none that stayed.

    By ``ratio`` values are similar if their matching-blocks ratio reaches the threshold, in Arrow batches and only for
    lists of several; by ``edit`` if the share of edits is small, without Python.
    """
    if method == "edit":
        return F.aggregate(
            vals, F.slice(vals, 1, 0),
            lambda acc, x: F.when(F.exists(acc, lambda k: edit_similar(x["low"], k["low"], threshold)), acc).otherwise(F.concat(acc, F.array(x))),
        )
    lows = F.transform(vals, lambda v: v["low"])
    several = F.coalesce(F.size(vals) > 1, F.lit(False))
    # An empty list and no null: before each row Spark measures a batch for Python anew, in as many steps as nulls stand at its end.
    positions = dissimilar_positions(F.when(several, lows).otherwise(F.slice(F.array(F.lit("")), 1, 0)), threshold)
    return F.when(several, F.transform(positions, lambda i: F.get(vals, i))).otherwise(F.col(vals))


def similar_values(observations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The similar pairs ``attribute, a, b`` (a before b) among the different cleaned values of each attribute."""
    v = observations.select(F.col("attribute").alias("group"), F.lower(clean_value(F.col("value"))).alias("low")).distinct()
    return similar_pairs(v, threshold).withColumnRenamed("group", "attribute")


def by_confidence(vals: Column) -> Column:
    """The surest source first, ties in order."""
    return F.transform(F.array_sort(F.transform(vals, lambda v: F.struct((-v["conf"]).alias("minus"), v["pos"].alias("pos"), v.alias("v")))), lambda s: s["v"])


def numeric_clusters(vals: Column) -> Column:
    """In order, a number joins the first cluster whose seed is within 5 % of the seed, or else seeds a new one."""
    cluster = lambda x: F.struct(x["number"].alias("seed"), x["conf"].alias("weight"), x["value"].alias("value"), F.lit(1).alias("n"))

    def put(acc, x):
        close = lambda c: F.abs(x["number"] - c["seed"]) / F.when(c["seed"] == 0, 1.0).otherwise(c["seed"]) <= 0.05
        at = F.array_position(F.transform(acc, close), True)
        grown = lambda c, i: F.when(
            i + 1 == at, F.struct(c["seed"].alias("seed"), (c["weight"] + x["conf"]).alias("weight"), c["value"].alias("value"), (c["n"] + 1).alias("n"))
        ).otherwise(c)
        return F.when(at > 0, F.transform(acc, grown)).otherwise(F.concat(acc, F.array(cluster(x))))

    return F.aggregate(vals, F.slice(F.transform(vals, cluster), 1, 0), put)


def resolve(df: DataFrame, vals: str = "vals") -> DataFrame:
    """Adds ``chosen, reason, conflicts`` for the ordered values in ``vals``.

    With a number among them, the heaviest cluster's first value wins if it is over 10 % from the surest number, or else
    the surest number; without, the surest value.
    """
    numeric = F.filter(vals, lambda v: v["number"].isNotNull())
    out = df.withColumn("_num", numeric).withColumn("_clusters", numeric_clusters(F.col("_num")))
    top = F.array_max(F.transform("_clusters", lambda c: c["weight"]))
    out = out.withColumn("_best", F.get(F.filter("_clusters", lambda c: c["weight"] == top), F.lit(0)))
    out = out.withColumn("_high", F.get(by_confidence(F.col("_num")), F.lit(0))).withColumn("_sure", by_confidence(F.col(vals)))
    high = F.col("_high.number")
    far = F.abs(F.col("_best.seed") - high) / F.when(high == 0, 1.0).otherwise(high) > 0.1
    first = F.get("_sure", F.lit(0))
    chosen = F.when(F.size("_num") == 0, first["value"]).when(far, F.col("_best.value")).otherwise(F.col("_high.value"))
    reason = (
        F.when(F.size("_num") == 0, F.concat(F.lit("Highest confidence source: "), first["source"]))
        .when(far, F.format_string("Consensus from %d sources", F.col("_best.n")))
        .otherwise(F.concat(F.lit("Highest confidence source: "), F.col("_high.source")))
    )
    out = out.withColumn("chosen", chosen).withColumn("reason", reason)
    others = F.when(F.size("_num") == 0, F.transform(F.slice("_sure", 2, F.greatest(F.lit(0), F.size("_sure") - 1)), lambda v: v["value"])).otherwise(
        F.transform(F.filter("_num", lambda v: v["value"] != F.col("chosen")), lambda v: v["value"])
    )
    return out.withColumn("conflicts", others).drop("_num", "_clusters", "_best", "_high", "_sure")


def active_rules(rules: DataFrame) -> DataFrame:
    """The active rule of each attribute, of several the last by ``created_at`` (if given), then ``rule_id``."""
    w = Window.partitionBy("attribute").orderBy(*[F.desc_nulls_last(c) for c in ("created_at", "rule_id") if c in rules.columns])
    return rules.where("active").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "active", "created_at")


def standardize(observations: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """D7 to D11 for every product and attribute: multi-value, enum, numeric and default rules in this order.

    Attributes with nothing but empty values come out with ``status`` ``error``. Rules are broadcast up to ``max_rules``.
    """
    rules = rules.select("attribute", "type", "allowed", "min", "max", "unit", "multi_value")
    rules = F.broadcast(rules) if rules.count() <= max_rules else rules
    lists = marked_lists(observations).withColumn("vals", by_confidence(F.col("vals")))
    out = resolve(lists.join(rules, "attribute", "left"))
    top = F.get("vals", F.lit(0))["conf"]
    number = number_and_unit(F.col("chosen"))
    matches = F.flatten(F.transform("vals", lambda v: F.transform(F.filter("allowed", lambda a: F.contains(v["low"], F.lower(a))), lambda a: F.struct(a.alias("a"), v["conf"].alias("conf")))))
    out = out.withColumn("_match", F.when(F.col("type") == "enum", F.get(matches, F.lit(0)))).withColumn("_q", number)
    kind = (
        F.when(F.col("vals").isNull(), "error").when(F.coalesce("multi_value", F.lit(False)), "multi")
        .when(F.col("_match").isNotNull(), "enum").when((F.col("type") == "numeric") & F.col("_q.number").isNotNull(), "numeric")
        .when(F.col("type") == "numeric", "unparsed").otherwise("default")
    )
    out = out.withColumn("_kind", kind)
    unique = F.array_sort(F.array_distinct(F.transform("vals", lambda v: v["value"])))
    clamped = F.greatest(F.least(F.col("_q.number"), F.col("max")), F.col("min"))
    pick = lambda **by: F.coalesce(*[F.when(F.col("_kind") == k, v) for k, v in by.items()])
    hundredths = F.aggregate("vals", F.lit(0.0), lambda acc, v: acc + F.round(v["conf"] * 100))
    mean = F.round(hundredths / F.size("vals")) / 100
    return out.select(
        *_KEYS,
        F.when(F.col("blank"), "error").otherwise("ok").alias("status"),  # a filter on it needs no other column
        pick(multi=F.array_join(unique, ", "), enum=F.col("_match.a"), unparsed=F.col("chosen"), default=F.col("chosen")).alias("standard_value"),
        F.when(F.col("_kind") == "numeric", clamped).alias("standard_number"),
        F.when(F.col("_kind") == "numeric", F.coalesce("_q.unit", "unit")).alias("unit"),
        F.transform("vals", lambda v: v["source"]).alias("derived_from"),
        pick(multi=mean, enum=F.least(F.col("_match.conf") + 0.05, F.lit(1.0)), numeric=top, unparsed=F.lit(0.5), default=top).alias("confidence"),
        pick(
            multi=F.format_string("Aggregated %d unique values", F.size(unique)), enum=F.concat(F.lit("Matched allowed enum: "), F.col("_match.a")),
            numeric=F.col("reason"), unparsed=F.lit("Failed to parse numeric value, stored as string"), default=F.col("reason"),
        ).alias("reason"),
        pick(
            enum=F.transform(F.filter("vals", lambda v: v["value"] != F.col("_match.a")), lambda v: v["value"]),
            numeric=F.col("conflicts"), default=F.col("conflicts"),
        ).alias("conflicts"),
    )


def route_to_review(standardized: DataFrame, threshold: float = REVIEW_BELOW) -> tuple[DataFrame, DataFrame]:
    """Kept rows and rows for review. The rows are written down once: both read them, and a filter on what is computed
    from folds would be put before the folds, which then run for each mention of their results.
    """
    standardized = written(standardized)
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    review = standardized.where(low).withColumn("reason", F.concat(F.lit("Low Confidence: "), F.coalesce("reason", F.lit("no value"))))
    return standardized.where(~low), review


def standardize_catalog(attributes: DataFrame, rules: DataFrame, old: DataFrame) -> DataFrame:
    """Standardized rows of every product in ``attributes(product_code, attribute, value)``, put over ``old``."""
    observed = attributes.select(F.col("product_code").alias("product_key"), "attribute", F.lit(0).cast("long").alias("pos"), "value", F.lit("truth_engine").alias("source"))
    done = standardize(observed, rules)
    value = F.coalesce("standard_value", F.col("standard_number").cast("string"))
    fresh = done.select(F.col("product_key").alias("product_code"), "attribute", "status", value.alias("standard_value"), F.coalesce("unit", F.lit("string")).alias("standard_format"), "confidence")
    return old.join(fresh.select("product_code").distinct(), "product_code", "left_anti").unionByName(fresh)


def standardize_payload(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """For each product, its attributes, whether one needs review, and how many do; invalid values are left out."""
    from lodestone.operators.cleaning import clean_attribute

    valid = clean_attribute(observations).where("status = 'valid'").select("product_key", "attribute", "pos", F.col("normalized").alias("value"), "source")
    done = standardize(valid, rules)
    low = F.coalesce(F.col("confidence") < REVIEW_BELOW, F.lit(True))
    return done.groupBy("product_key").agg(F.count("*").alias("n_attributes"), F.bool_or(low).alias("review_required"), F.count_if(low).alias("queue_size"))


def snake_case(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unify_attributes(labels: DataFrame, synonyms: DataFrame, max_synonyms: int = 100_000) -> DataFrame:
    """Canonical attribute of each label of ``labels(label)`` and its confidence; unknown labels keep their own form."""
    known = F.broadcast(synonyms) if synonyms.count() <= max_synonyms else synonyms
    joined = labels.select("label").distinct().join(known, "label", "left")
    return joined.select("label", F.coalesce("canonical", snake_case(F.col("label"))).alias("canonical"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"))


def gather_canonical_values(extracted: DataFrame, unified: DataFrame, max_labels: int = 100_000) -> DataFrame:
    """Observations of canonical attributes from ``extracted(product_key, source_pos, label, value, source)``, by source and then label.

    A few labels hold most rows, so rows aren't dealt out by them: ``unified`` is written down and broadcast up to ``max_labels``.
    """
    names = written(unified.select("label", "canonical").where("canonical <> ''"))
    names = F.broadcast(names) if names.count() <= max_labels else names
    w = Window.partitionBy("product_key", "canonical").orderBy("source_pos", "label", "value")
    rows = extracted.join(names, "label")
    return rows.withColumn("pos", F.row_number().over(w).cast("long")).select("product_key", F.col("canonical").alias("attribute"), "pos", "value", "source")


def canonical_conflict(observations: DataFrame) -> DataFrame:
    """Whether the values of an attribute differ in more than spelling."""
    raw = observations.groupBy(*_KEYS, "value").agg(F.count("*").alias("n"))
    values = raw.select(*_KEYS, "n", clean_value(F.col("value")).alias("v")).withColumn("q", number_and_unit(F.col("v")))
    form = F.when(F.col("q.number").isNotNull(), F.concat_ws(" ", F.col("q.number").cast("string"), F.col("q.unit"))).otherwise(F.lower("v"))
    forms = values.select(*_KEYS, "n", form.alias("form")).groupBy(*_KEYS, "form").agg(F.sum("n").alias("n"))
    counts = forms.groupBy(*_KEYS).agg(F.sum("n").alias("n_values"), F.count("form").alias("n_forms"))
    return counts.withColumn("conflict", F.col("n_forms") > 1)
