"""Reads and snapshot updates of the catalog tables. Every update returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.keyed import one_per_key


def newest(df: DataFrame, by: str, key: str) -> DataFrame:
    """The latest rows by a time first, equal times by a key; rows without a time come last."""
    return df.orderBy(F.col(by).desc_nulls_last(), key)


def project_priorities(priorities: DataFrame, project_id: str | None = None) -> DataFrame:
    """R2: priorities of a project (of all without one), by rank."""
    rows = priorities if project_id is None else priorities.where(F.col("project_id") == project_id)
    return rows.orderBy("project_id", "priority_rank")


def review_pending(items: DataFrame, status: str | None = None) -> DataFrame:
    """Review items of a status; ``all`` or none gives every item."""
    return items if status in (None, "all") else items.where(F.col("status") == status)


def source_metrics(sources: DataFrame, extractions: DataFrame) -> DataFrame:
    """Mean confidence, distinct labels and completeness of each source; zeros without extractions.

    ``extractions(source_id, confidence, attributes map)``. The mean is taken before attributes are exploded.
    """
    mean = extractions.groupBy("source_id").agg(F.avg("confidence").alias("c"))
    labels = extractions.select("source_id", F.explode(F.map_keys("attributes")).alias("label")).groupBy("source_id").agg(F.countDistinct("label").alias("n"))
    joined = sources.select("source_id").join(mean, "source_id", "left").join(labels, "source_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "source_id", F.round(F.coalesce("c", F.lit(0.0)), 2).alias("avg_confidence"), n.alias("n_attributes"), F.round(F.least(n / 20.0, F.lit(1.0)), 2).alias("completeness")
    )


def attribute_evidence(attributes: DataFrame, extractions: DataFrame) -> DataFrame:
    """For each attribute of a product, its evidence in extractions of the same code; the master value without any.

    ``evidence`` lists value, confidence and source of each, in this order; there is a conflict if values differ.
    ``extractions(sku, source_id, confidence, attributes map)``.
    """
    long = extractions.select(F.col("sku").alias("product_code"), F.col("source_id"), "confidence", F.explode("attributes").alias("attribute", "evidence"))
    joined = attributes.join(long, ["product_code", "attribute"], "left")
    found = F.col("evidence").isNotNull()
    source = F.substring(F.col("source_id").cast("string"), 1, 8)
    item = lambda value, confidence, source: F.struct(value.alias("value"), confidence.alias("confidence"), source.alias("source"))
    listed = F.sort_array(F.collect_list(F.when(found, item(F.col("evidence"), F.col("confidence").cast("double"), source))))
    master = F.array(item(F.col("value"), F.lit(1.0), F.lit("Truth Engine")))
    return joined.groupBy("product_code", "attribute", F.col("value")).agg(
        listed.alias("listed"),
        F.count_if(found).alias("n_evidence"), (F.countDistinct("evidence") > 1).alias("conflict"),
        F.coalesce(F.max("confidence"), F.lit(1.0)).alias("top_confidence"),
    ).select(
        "product_code", "attribute", F.col("value").alias("master"), F.when(F.size("listed") > 0, F.col("listed")).otherwise(master).alias("evidence"),
        "n_evidence", "conflict", "top_confidence",
    )


def golden_records(products: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Completed products with their first enrichment, if any."""
    w = Window.partitionBy("product_id").orderBy("seo_title")
    first = enrichments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return products.where("enrichment_status = 'completed'").join(first, "product_id", "left")


def publishable(products: DataFrame, least: int = 80) -> DataFrame:
    """Complete enough and not published."""
    return products.where((F.col("completeness_score") >= least) & F.col("published_at").isNull())


def publish(products: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Products with those of ``ids(product_id)`` published, and the audit rows; unknown ids come out as ``not_found``."""
    wanted = ids.select("product_id").distinct()
    marked = products.join(wanted.withColumn("_hit", F.lit(True)), "product_id", "left")
    done = marked.withColumn("published_at", F.when(F.col("_hit"), at).otherwise(F.col("published_at"))).drop("_hit")
    known = wanted.join(products.select("product_id").withColumn("_known", F.lit(True)), "product_id", "left")
    audit = known.select("product_id", F.when(F.col("_known"), "published").otherwise("not_found").alias("stage"))
    return done, audit


def dashboard_metrics(projects: DataFrame, products: DataFrame) -> DataFrame:
    """Counts of projects and products and the mean completeness, cut to a whole number; one row of two aggregates."""
    a = projects.agg(F.count("*").alias("total_projects"), F.count_if(F.col("status") == "active").alias("active_projects"))
    b = products.agg(
        F.count("*").alias("total_products"), F.count_if(F.col("published_at").isNotNull()).alias("published_products"),
        F.coalesce(F.avg("completeness_score"), F.lit(0)).cast("int").alias("catalog_health"),
    )
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def review_stats(items: DataFrame) -> DataFrame:
    """Counts by status in one pass."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.agg(F.count("*").alias("total"), of("pending"), of("approved"), of("rejected"), F.lit(0).cast("long").alias("in_review"))


def put_attributes(attributes: DataFrame, changes: DataFrame) -> DataFrame:
    """``attributes(product_code, attribute, value)`` with ``changes`` over it; one change for each key at most."""
    key = ["product_code", "attribute"]
    new = changes.select(*key, F.col("value").alias("_new"))
    return attributes.join(new, key, "full_outer").select(*key, F.coalesce("_new", "value").alias("value"))


def approve_items(items: DataFrame, attributes: DataFrame, chosen: DataFrame, by: list[str], reviewer: str = "Human Validator") -> tuple[DataFrame, DataFrame]:
    """Items that match ``chosen`` by queue id or (product, attribute) are approved, and their values written.

    Of several approvals for one attribute the one with the largest queue id stands.
    """
    hit = items.join(chosen.select(*by).distinct(), by, "left_semi")
    out = _mark(items, hit, "approved", reviewer)
    last = hit.groupBy("product_code", "attribute").agg(F.max_by("proposed_value", "queue_id").alias("value"))
    return out, put_attributes(attributes, last)


def _first_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    key = ["product_code", "attribute"]
    first = items.groupBy(*key).agg(F.min("queue_id").alias("queue_id"))
    return first.join(keys, key)


def _mark(items: DataFrame, hit: DataFrame, status: str, reviewer: str) -> DataFrame:
    marked = items.join(hit.select("queue_id").distinct().withColumn("_hit", F.lit(True)), "queue_id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).withColumn("reviewer", F.when(F.col("_hit"), reviewer)).drop("_hit")


def override_items(items: DataFrame, attributes: DataFrame, overrides: DataFrame, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """The first item of each ``overrides(product_code, attribute, value)`` is approved with the value, which is written."""
    hit = _first_items(items, overrides)
    marked = _mark(items, hit, "approved", reviewer).join(hit.select("queue_id", F.col("value").alias("overridden_value")), "queue_id", "left")
    return marked, put_attributes(attributes, hit.select("product_code", "attribute", "value"))


def reject_items(items: DataFrame, keys: DataFrame, reviewer: str) -> DataFrame:
    """The first item of each (product, attribute) is rejected."""
    return _mark(items, _first_items(items, keys), "rejected", reviewer)


def sync_rows(current: DataFrame, incoming: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """By key, incoming rows replace current ones whole (their nulls too) or are added; one row for each key."""
    incoming = one_per_key(incoming, key, order)
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def resolve_issues(issues: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The issues of ``ids`` are resolved."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return issues.join(hit, key, "left").withColumn("resolved", F.coalesce("_hit", F.col("resolved"))).drop("_hit")


def audit_latest(audit: DataFrame, n: int = 100) -> DataFrame:
    """The newest rows, ties by id; a top-k without a full sort."""
    return audit.orderBy(F.desc("logged_at"), F.desc("id")).limit(n)


def page(rows: DataFrame, key: str, skip: int, limit: int = 100) -> DataFrame:
    """One page in the order of a key."""
    return rows.orderBy(key).offset(skip).limit(limit)


def get_by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def create_rows(current: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """New rows added, their missing or null columns set to defaults."""
    for column, value in defaults.items():
        given = F.col(column) if column in new.columns else F.lit(None)
        new = new.withColumn(column, F.coalesce(given, F.lit(value)).cast(current.schema[column].dataType))
    return current.unionByName(new, allowMissingColumns=True)


def patch_rows(current: DataFrame, patches: DataFrame, key: str, fields: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns that a patch gives are replaced, others stay; patches of unknown keys change nothing.

    A patch gives the columns named in its array ``fields``, nulls too; where that is null, or without it, those that are not
    null. Of several patches for a key each column takes the last one that gives it, by the columns ``order`` and then by
    value. ``fields`` and ``order`` are no columns of the rows.
    """
    given = [c for c in patches.columns if c != key and c != fields and c not in (order or [])]
    said = lambda c: F.coalesce(F.array_contains(fields, c), F.col(c).isNotNull()) if fields else F.col(c).isNotNull()
    rank = [F.col(c).alias(f"o{k}") for k, c in enumerate(order or [])]
    last = patches.groupBy(key).agg(*[F.max(F.when(said(c), F.struct(*rank, F.col(c).alias("v")))).alias(f"_{c}") for c in given])
    joined = current.join(last, key, "left")
    put = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(current.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return joined.select(*[put(c) if c in given else F.col(c) for c in current.columns])


def delete_rows(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows without those of ``ids``."""
    return current.join(ids.select(key).distinct(), key, "left_anti")


def of_project(rows: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of a project."""
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


def first_of_product(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each product."""
    w = Window.partitionBy("product_id").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def queue_size_per_product(items: DataFrame) -> DataFrame:
    """Pending items of each product and the attributes that they are about."""
    pending = items.where("status = 'pending'")
    return pending.groupBy("product_code").agg(F.count("*").alias("queue_size"), F.array_join(F.array_sort(F.collect_set("attribute")), ",").alias("attributes"))
