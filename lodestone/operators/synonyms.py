"""Labels that mean the same, found by the values that they have in common (D16 beyond a table of synonyms).

Each label has a sketch: the hashes of its different values, the smallest ``size`` of them, which is a fair sample of its
values whatever their number. The share of a label's sketch among all values of another label measures how far it is
contained there. A label is held only against labels that have one of its rarest sketched values: as many as it may lack at
the wanted containment, and one more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_value, number_and_unit
from lodestone.operators.standardize import snake_case
from lodestone.storage import written


#: A value that is a number with or without a unit.
QUANTITY = r"^[0-9][0-9,]*(\.[0-9]+)?\s*([a-z]+|[\"′″])?$"


def value_form(value: Column) -> Column:
    """What values are compared by: number and unit where that is all, or else the cleaned text in lower case."""
    low = F.lower(clean_value(value))
    q = number_and_unit(low)
    return F.when(low.rlike(QUANTITY) & q["number"].isNotNull(), F.concat_ws(" ", q["number"].cast("string"), q["unit"])).otherwise(low)


def value_hashes(observations: DataFrame) -> DataFrame:
    """``label, h``: a hash of each different value of each label; null labels and empty values are left out."""
    rows = observations.where("label is not null").select("label", value_form(F.col("value")).alias("form")).where("form <> ''")
    return rows.select("label", F.xxhash64("form").alias("h")).distinct()


def label_containment(observations: DataFrame, least: float = 0.8, support: int = 3, size: int = 256, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``label, other, shared, compared, containment`` of labels whose values are mostly values of another label.

    ``compared`` is the size of the label's sketch and ``shared`` the number of its values that the other label has. Pairs
    with a share of ``least`` and ``support`` shared values are given. For labels of at most ``size`` different values the
    containment is exact, beyond that its standard error is at most ``0.5 / sqrt(size)``. The same observations give the same
    rows. ``cut`` writes down the different values, which are used several times.
    """
    hashes = cut(value_hashes(observations))
    sketch = hashes.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("n") <= size).drop("n")
    sizes = sketch.groupBy("label").agg(F.count("*").alias("compared")).where(F.col("compared") >= support)
    times = hashes.groupBy("h").agg(F.count("*").alias("times"))
    ranked = sketch.join(times, "h").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("times", "h"))).join(sizes, "label")
    needed = F.greatest(F.ceil(F.col("compared") * least - 1e-9), F.lit(support))
    rare = ranked.where((F.col("rank") <= F.col("compared") - needed + 1) & (F.col("times") > 1)).select("label", "h")
    other = hashes.select(F.col("label").alias("other"), "h")
    pairs = rare.join(other, "h").where("label <> other").select("label", "other").distinct()
    held = pairs.join(sketch, "label").join(other, ["other", "h"])
    found = held.groupBy("label", "other").agg(F.count("*").alias("shared")).join(sizes, "label")
    found = found.where(F.col("shared") >= F.greatest(F.ceil(F.col("compared") * least - 1e-9), F.lit(support)))
    return found.select("label", "other", "shared", "compared", (F.col("shared") / F.col("compared")).alias("containment"))


def discovered_synonyms(observations: DataFrame, synonyms: DataFrame, least: float = 0.8, support: int = 3, size: int = 256) -> DataFrame:
    """Rows ``label, canonical, confidence`` for labels that ``synonyms`` lacks, by ``label_containment``.

    A label takes the canonical name of the label that it is contained in most, known ones before others, then the more
    shared values, then the first by name; of two unknown labels that contain each other the first by name gives the name. The
    confidence is the containment. Labels that nothing contains have no row.
    """
    known = synonyms.groupBy("label").agg(F.min("canonical").alias("canonical"))
    pairs = written(label_containment(observations, least, support, size)).join(known.select("label"), "label", "left_anti")
    pairs = pairs.join(known.withColumnRenamed("label", "other"), "other", "left")
    back = pairs.select(F.col("other").alias("label"), F.col("label").alias("other"), F.lit(True).alias("both"))
    pairs = pairs.join(back, ["label", "other"], "left").where("canonical is not null or both is null or other < label")
    w = Window.partitionBy("label").orderBy(F.col("canonical").isNull(), F.desc("containment"), F.desc("shared"), "other")
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("label", F.coalesce("canonical", snake_case(F.col("other"))).alias("canonical"), F.col("containment").alias("confidence"))
