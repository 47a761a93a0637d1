"""Scalar functions: ids, and lenient readings of loosely typed values. All are column expressions but python_text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.fixed import FEATURE_SCHEMA

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"
WHOLE = r"^[-+]?[0-9]+$"
FRACTION = r"^[-+]?(?:(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+)$"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(*parts: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by U+001F; str parts are literals, null counts as empty."""
    texts = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.array_join(F.array(*texts), "\x1f"), 256), 1, 16)


def evidence_query_id(scenario: Column, contact: Column, time: Column, hypothesis: Column) -> Column:
    return stable_id("feature-query", scenario, contact, time, hypothesis, FEATURE_SCHEMA)


def node_id(kind: str, *parts: Column) -> Column:
    """Ids of graph nodes: the kind, then the parts (names in lower case)."""
    return stable_id(kind, *parts)


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def optional_double(c: Column) -> Column:
    """Text to double as lenient scripts read it: blanks around and single underscores are fine, nan and inf too."""
    t = strip(c.cast("string"))
    bare = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    special = F.when(bare == "nan", F.lit(float("nan"))).when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).when(t.rlike(_SPECIAL), special)


def finite(c: Column) -> Column:
    """c where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite_double(c: Column) -> Column:
    return finite(optional_double(c))


def bounded(c: Column) -> Column:
    """A double within 0 to 1; null, NaN and infinity count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(c), F.lit(0.0))))


def non_negative(c: Column) -> Column:
    """A double, 0 where it is null, negative or not finite."""
    x = finite(c)
    return F.when(x > 0, x).otherwise(0.0)


def clean_text(c: Column) -> Column:
    """Trimmed text; unknown for null and blank."""
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit("unknown"))


def coerced(c: Column) -> Column:
    """Text to VARIANT: true or false in any case, whole numbers, decimal or exponent numbers; else the trimmed text."""
    t = strip(c)
    as_text = t.cast("variant")
    whole = F.coalesce(t.try_cast("long").cast("variant"), t.try_cast("decimal(38,0)").cast("variant"), as_text)
    return (
        F.when(F.lower(t) == "true", F.lit(True).cast("variant"))
        .when(F.lower(t) == "false", F.lit(False).cast("variant"))
        .when(t.rlike(WHOLE), whole)
        .when(t.rlike(FRACTION), F.coalesce(t.try_cast("double").cast("variant"), as_text))
        .when(t.isNotNull(), as_text)
    )


def optional_bool(c: Column) -> Column:
    """Text that coerced() reads as a boolean."""
    t = F.lower(strip(c))
    return F.when(t == "true", True).when(t == "false", False)


def _scalar_text(x: str) -> str:
    t = x.strip()
    if t.lower() in ("true", "false"):
        return t.lower().title()
    if re.fullmatch(WHOLE, t):
        return str(int(t)) if len(t) < 4000 else t
    return repr(float(t)) if re.fullmatch(FRACTION, t) else t


def _scalar_texts(raw: pd.Series) -> pd.Series:
    return raw.map(_scalar_text, na_action="ignore")


def python_text(c: Column) -> Column:
    """The text of a scalar after coercion and back, as ids need it: 007 is 7, 1e3 is 1000.0, TRUE is True. Arrow UDF."""
    return F.pandas_udf(_scalar_texts, "string")(c)


def variant_number(record: Column, path: str) -> Column:
    """A finite double from a VARIANT: numbers, numeric text, and booleans as 1 and 0."""
    got = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(got) == "BOOLEAN", F.try_variant_get(record, path, "boolean").cast("int").cast("double")).otherwise(finite_double(F.try_variant_get(record, path, "string")))


def first_number(record: Column, *keys: str, nested: str = "features") -> Column:
    """The first finite number among keys of the record, then among those of its nested record."""
    return F.coalesce(*(variant_number(record, f"$.{k}") for k in keys), *(variant_number(record, f"$.{nested}.{k}") for k in keys))


def first_text(record: Column, *keys: str, default: str = "") -> Column:
    """The first value among keys that is neither null nor the empty text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(record, f"$.{k}", "string"), F.lit("")) for k in keys), F.lit(default))


def fixed_point(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", c)
