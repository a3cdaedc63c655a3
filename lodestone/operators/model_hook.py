"""User functions on rows that never fail the job, and the exact ratio of similar texts."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value_json", T.StringType()), T.StructField("error", T.StringType()), T.StructField("details", T.StringType())])


def safe_apply(rows: DataFrame, id_col: str, text_col: str, function: Callable[[str], dict], backup: Callable[[str], dict] | None = None) -> DataFrame:
    """``function`` on each text, then ``backup`` if it raises; failures come out as rows.

    Errors: ``empty_prompt`` for a blank text, ``invalid_response`` for a result that is no dict, ``llm_exception``.
    """

    def one(text: str | None) -> tuple:
        if not text or not text.strip():
            return False, None, "empty_prompt", None
        failure = ""
        for f in (function, backup):
            if f is not None:
                try:
                    out = f(text)
                except Exception as e:  # noqa: BLE001  a user's function may raise anything
                    failure = str(e)
                    continue
                if isinstance(out, dict):
                    return True, json.dumps(out, sort_keys=True), None, None
                return False, None, "invalid_response", str(out)
        return False, None, "llm_exception", failure

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *RESULT.fields])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *one(t)) for i, t in zip(pdf[id_col], pdf[text_col], strict=True)], columns=schema.names)

    return rows.select(id_col, text_col).mapInPandas(run, schema)


def similarity_ratio(a: Column, b: Column) -> Column:
    """The exact matching-blocks ratio; not symmetric, so the new value comes first. For pruned pairs only."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def dissimilar_positions(values: Column, threshold: float = 0.9) -> Column:
    """D3: for an array of texts the positions, from 0, of those that stay: each whose ratio with none that stayed reaches
    ``threshold``. A text is held against those of a length that allows it, by bounds on the ratio first."""

    def kept(texts) -> list[int]:
        out, by_length = [], defaultdict(list)
        for k, new in enumerate(texts):
            n = len(new)
            near = range(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)
            lengths = near if len(near) < len(by_length) else [m for m in by_length if m in near]
            for seen in (s for m in lengths for s in by_length.get(m, ())):
                match = SequenceMatcher(None, new, seen)
                if new == seen or match.quick_ratio() >= threshold and match.ratio() >= threshold:
                    break
            else:
                out.append(k)
                by_length[n].append(new)
        return out

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def positions(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kept(x) for x in lists], dtype=object)

    return positions(values)
