"""Fixed values and schemas of the catalog."""

from __future__ import annotations

from pyspark.sql import types as T

# Confidence of a source, words that stand for no value, thresholds and limits.
SOURCE_CONFIDENCE = {
    "manufacturer": 0.95, "official_site": 0.90, "truth_engine": 0.88, "datasheet": 0.90, "web": 0.70, "vendor": 0.65, "inference": 0.40,
}
DEFAULT_CONFIDENCE = 0.5
INVALID_VALUES = ("n/a", "-", "unknown", "none", "", "not specified", "tbd")
REVIEW_BELOW = 0.85
ENRICHMENT_REVIEW_BELOW = 0.8
MAX_QUERIES, MAX_LINKS, MAX_SOURCES = 1, 5, 3
DOCUMENT_CHARS = 12_000
MIN_PAGE_CHARS = 100

RULE_FIELDS = "attribute string, type string, allowed array<string>, min double, max double, unit string, multi_value boolean"
#: Example rules for the derived views.
EXAMPLE_RULES = [
    ("r1", "grade", "enum", ["Grade A", "Grade B", "Grade C"], None, None, None, False, True),
    ("r2", "width", "numeric", None, 2.0, 45.0, "inches", False, True),
    ("r3", "extras", None, None, None, None, None, True, True),
    ("r4", "finish", "enum", ["Matt"], None, None, None, False, False),
]
RULES_SCHEMA = f"rule_id string, {RULE_FIELDS}, active boolean"

OBSERVATION = T.StructType([
    T.StructField("product_key", T.LongType()), T.StructField("attribute", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("value", T.StringType()), T.StructField("source", T.StringType()),
])
SOURCE_SUBMISSION = T.StructType([
    T.StructField("source_id", T.LongType()), T.StructField("source_type", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("project_id", T.StringType()), T.StructField("content", T.StringType()),
])
ENRICHMENT = T.StructType([
    T.StructField("seo_title", T.StringType()), T.StructField("bullets", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("use_cases", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
])
