"""Log lines: key-value and positional records, and JSON objects buried in text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed import EXPORT_SCHEMA, LOG_MARK, OBSERVATION_SOURCE
from tracewright.functions.values import strip

_FIELD = r"\s*([^:,]+?)\s*:\s*(.*?)\s*(?=\s*,\s*[^:,]+?\s*:|\s*$)"


def has_mark(text: Column, mark: str = LOG_MARK) -> Column:
    return F.contains(text, F.lit(mark))


def key_values(text: Column, mark: str = LOG_MARK) -> Column:
    """The key : value pairs after the first mark, as a map of trimmed texts; of repeated keys the last counts.

    Values may hold colons: a new pair starts at a comma that has a key and a colon behind it. Null without the mark.
    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN (tracewright.session sets it).
    """
    payload = F.substr(text, F.instr(text, mark) + F.lit(len(mark)))
    names = F.transform(F.regexp_extract_all(payload, F.lit(_FIELD), F.lit(1)), strip)
    values = F.transform(F.regexp_extract_all(payload, F.lit(_FIELD), F.lit(2)), strip)
    return F.when(has_mark(text, mark), F.map_from_arrays(names, values))


def positional(text: Column, mark: str = LOG_MARK) -> Column:
    """The comma-separated values after the last mark and comma; null without the mark."""
    return F.when(has_mark(text, mark), F.split(F.element_at(F.split(text, rf"\Q{mark},\E"), -1), ","))


def objects_in_line(text: str) -> list[str]:
    """Balanced {...} parts of a text; quotes count only inside of one, and one without an end is left out."""
    out, start, depth, quoted, escaped = [], -1, 0, False, False
    for i, c in enumerate(text):
        if start < 0:
            if c == "{":
                start, depth, quoted, escaped = i, 1, False, False
        elif quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
                start = -1
    return out


def objects_in_reply(text: str) -> list[str]:
    """Balanced {...} parts of a model's reply; here quotes count outside of objects as well."""
    out, start, depth, quoted, escaped = [], -1, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted, escaped = True, False
        elif c == "{":
            start, depth = (i if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def explode_objects(df: DataFrame, text: str, finder=objects_in_line) -> DataFrame:
    """A row for each balanced object in text, with the columns nth (from 0) and object; df's other columns stay."""

    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: finder(x) if x else [])

    return df.select("*", F.posexplode(F.pandas_udf(find, "array<string>")(F.col(text))).alias("nth", "object"))


def recover_records(lines: DataFrame, unique: bool = False) -> DataFrame:
    """line, record (VARIANT) and canonical (JSON with sorted keys) of export records inside lines(line, text).

    Records have the export's schema or its source. With unique, of equal records the first one stays.
    """
    found = explode_objects(lines.select("line", "text"), "text").withColumn("record", F.try_parse_json("object"))
    keep = (F.try_variant_get("record", "$.export_schema", "string") == EXPORT_SCHEMA) | (F.try_variant_get("record", "$.source", "string") == OBSERVATION_SOURCE)
    found = found.filter(keep).withColumn("canonical", canonical_json(F.col("object")))
    if unique:
        first = found.groupBy("canonical").agg(F.min(F.struct("line", "nth")).alias("at")).select("canonical", "at.*")
        found = found.join(first, ["canonical", "line", "nth"], "left_semi")
    return found.select("line", "nth", "record", "canonical")


def canonical_json(c: Column) -> Column:
    """JSON text again with sorted keys and no blanks. Arrow UDF."""
    return F.pandas_udf(_canonical, "string")(c)


def _canonical(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")), na_action="ignore")


def spaced_json(c: Column) -> Column:
    """JSON text again with sorted keys and a blank after colons and commas, as record ids need it. Arrow UDF."""
    return F.pandas_udf(_spaced, "string")(c)


def _spaced(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: json.dumps(json.loads(x), sort_keys=True), na_action="ignore")
