"""Explanation texts of probability records. Texts never change probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewright.functions.fixed import EXPLANATION_SCHEMA, NOTE_CLOSE, NOTE_LOW, NOTE_UNKNOWN
from tracewright.functions.names import is_unknown_nation
from tracewright.functions.values import fixed_point

EVIDENCE = "array<struct<text:string,source:string>>"


def evidence_lines(items: Column, empty: str, prefix: str = "  ") -> Column:
    """Numbered lines of evidence(text, source), the source in brackets; else the line for none."""
    line = lambda x, i: F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(". "), F.coalesce(x["text"], F.lit("None")), F.when(F.coalesce(x["source"], F.lit("")) != "", F.concat(F.lit(" ("), x["source"], F.lit(")"))).otherwise(""))
    lines = F.transform(F.coalesce(items, F.array().cast(EVIDENCE)), line)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(prefix + empty)


def ordered_json(distribution: Column) -> Column:
    """A distribution as a JSON object with sorted names."""
    named = F.array_sort(F.transform(distribution, lambda x: F.struct(x["name"].alias("name"), x["p"].alias("p"))))
    item = lambda x: F.concat(F.to_json(F.struct(x["name"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["name"].alias("k")))) - 6), F.lit(": "), x["p"].cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(named, item), ", "), F.lit("}"))


def notes(top: Column, platforms: Column, nations: Column) -> Column:
    """The uncertainty notes that apply, in order."""
    gap = platforms[0]["p"] - F.try_element_at(platforms, F.lit(2))["p"]
    unknown = F.exists(nations, lambda x: is_unknown_nation(x["name"]))
    return F.array_compact(F.array(F.when(top < 0.6, NOTE_LOW), F.when(gap < 0.15, NOTE_CLOSE), F.when(unknown, NOTE_UNKNOWN)))


def summary(platform: Column, p: Column, nation: Column, q: Column) -> Column:
    return F.concat(F.lit("Most likely emitter platform is "), platform, F.lit(" with probability "), fixed_point(p), F.lit("; most likely operator nation is "), nation, F.lit(" with probability "), fixed_point(q), F.lit("."))


def explanation_payloads(records: DataFrame) -> DataFrame:
    """schema, keys, summary, confidence_limits, the evidence lists and llm_prompt of probability records.

    records may have supporting_evidence, contradicting_evidence and missing_evidence (lists of text and source).
    """
    have = lambda c: F.col(c) if c in records.columns else F.array().cast(EVIDENCE)
    support, contradict, missing = (have(c) for c in ("supporting_evidence", "contradicting_evidence", "missing_evidence"))
    positive = F.filter("operator_nation_probabilities", lambda x: ~is_unknown_nation(x["name"]))
    recorded = ~is_unknown_nation(F.col("top_operator_nation"))
    nation = F.when(recorded, F.col("top_operator_nation")).otherwise(F.try_element_at(positive, F.lit(1))["name"])
    q = F.when(recorded, F.col("top_operator_nation_probability")).otherwise(F.try_element_at(positive, F.lit(1))["p"])
    s = summary(F.col("top_platform"), F.col("top_platform_probability"), nation, q)
    prompt = F.concat_ws(
        "\n",
        F.lit("Explain the supplied calibrated combat-identification probabilities without changing them."),
        s,
        F.concat(F.lit("Platform distribution: "), ordered_json(F.col("platform_probabilities"))),
        F.concat(F.lit("Operator-nation distribution (positive labels only): "), ordered_json(positive)),
        F.lit("Supporting evidence:"),
        evidence_lines(support, "none supplied"),
        F.lit("Contradicting evidence:"),
        evidence_lines(contradict, "none supplied"),
        F.lit("Missing evidence / recommended collection:"),
        evidence_lines(missing, "request additional emissions, kinematics, IFF, location, and source reliability evidence"),
    )
    keys = [c for c in ("scenario_id", "contact_id", "observation_time") if c in records.columns]
    return records.select(
        F.lit(EXPLANATION_SCHEMA).alias("schema"),
        *keys,
        s.alias("summary"),
        notes(F.col("top_platform_probability"), F.col("platform_probabilities"), F.col("operator_nation_probabilities")).alias("confidence_limits"),
        support.alias("supporting_evidence"),
        contradict.alias("contradicting_evidence"),
        missing.alias("missing_evidence"),
        prompt.alias("llm_prompt"),
    )


def hypothesis_prompt(observation_json: Column, rows_json: Column, n: int) -> Column:
    """The request for n hypotheses from an observation and the graph's rows."""
    return F.concat_ws(
        "\n",
        F.lit(f"Generate exactly {n} candidate emitter-platform/operator hypotheses from the knowledge-graph rows."),
        F.lit('Return JSON only: {"hypotheses":[{"hypothesis": str, "operator_nation": str, "rationale": str}]}'),
        F.concat(F.lit("Observation: "), observation_json),
        F.concat(F.lit("Knowledge-graph evidence rows: "), rows_json),
    )


def complete(df: DataFrame, prompt: str, fallback: str, completer: Callable[[list[str]], list[str | None]] | None = None, out: str = "explanation") -> DataFrame:
    """df with the completer's text for each prompt; without a completer, or where it gives none, the fallback column."""
    if completer is None:
        return df.withColumn(out, F.col(fallback))
    schema = StructType([*df.schema.fields, StructField("_text", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_text=completer(b[prompt].tolist()))

    return df.mapInPandas(run, schema).withColumn(out, F.coalesce(F.nullif(F.trim("_text"), F.lit("")), F.col(fallback))).drop("_text")
