"""Column functions on text: white space, placeholders, numbers with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schemas import DEFAULT_CONFIDENCE, INVALID_VALUES, SOURCE_CONFIDENCE


#: All white space in the Unicode sense, which ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.btrim(c, F.lit(WHITE))


def normalize_text(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def is_invalid(c: Column) -> Column:
    """Whether a value only says that there is none; null counts as empty."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*INVALID_VALUES)


def extract_number(c: Column) -> Column:
    """The first number as a double, or null."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+(\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def clean_value(c: Column, normalize_quotes: bool = False) -> Column:
    """Normalized, with the entities of quotes decoded; curly quotes become straight only on request."""
    normal = out = normalize_text(c)
    for entity, sign in (("&quot;", '"'), ("&apos;", "'"), ("&#34;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    if normalize_quotes:
        out = F.translate(out, "“”‘’", "\"\"''")
    # Without an entity there is nothing new to strip.
    return F.when(F.contains(normal, F.lit("&")), strip(out)).otherwise(normal if not normalize_quotes else strip(out))


#: Tried in this order; only the leftmost match of each counts.
_QUANTITIES = (r"([0-9,]+\.?[0-9]*)\s*([a-zA-Z]+)", r"([0-9,]+\.?[0-9]*)\s*([\"′″])", r"([0-9,]+\.?[0-9]*)$")


def number_and_unit(c: Column) -> Column:
    """``struct<number, unit>`` of the first pattern whose number parses: with letters, with a prime or quote, at the end."""
    number, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, pattern in reversed(list(enumerate(_QUANTITIES))):
        n = F.nullif(F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")
        u = F.lower(F.regexp_extract(c, pattern, 2)) if k < 2 else F.lit(None).cast("string")
        u = F.when(u.isin('"', "″", "inch"), "inches").otherwise(u) if k < 2 else u
        unit = F.when(n.isNotNull(), u).otherwise(unit)
        number = F.coalesce(n, number)
    return F.struct(number.alias("number"), unit.alias("unit"))


def source_confidence(source: Column) -> Column:
    """Confidence of a source; unknown ones get the default."""
    out = F.lit(DEFAULT_CONFIDENCE)
    for name, value in SOURCE_CONFIDENCE.items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


def edit_similar(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Equal, or with a share of at most ``1 - threshold`` of edits; for texts that are cleaned and in lower case."""
    longest = F.greatest(F.length(a), F.length(b))
    bound = F.lit(1 - threshold + 1e-9)
    near = F.abs(F.length(a) - F.length(b)) <= longest * bound
    return (a == b) | (near & (F.levenshtein(a, b) <= longest * bound))


def maybe_similar(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Whether the matching-blocks ratio can reach ``threshold``: it is one less edits over both lengths at most."""
    both, shorter = F.length(a) + F.length(b), F.least(F.length(a), F.length(b))
    return (2 * shorter >= both * F.lit(threshold - 1e-9)) & (F.levenshtein(a, b) <= both * F.lit(1 - threshold + 1e-9))
