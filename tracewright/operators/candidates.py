"""Candidate rows of a contact: logits, grouped softmax, marginals, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.fixed import FEATURE_WEIGHTS, PROBABILITY_SCHEMA
from tracewright.functions.geo import parse_polygon, with_distance
from tracewright.functions.names import is_unknown_nation
from tracewright.functions.probability import linear_logit
from tracewright.functions.values import first_number, first_text, variant_number

KEYS = ["scenario_id", "contact_id", "observation_time"]
NATION_KEYS = ["operator_nation", "operator_country", "nation", "country", "country_of_origin", "origin_country"]
PLATFORM_KEYS = ["hypothesis", "platform", "platform_type"]


def row_logit(record: Column, weights: dict[str, float] | None = None) -> Column:
    """feature_logit where the record has that key (null or bad: 0), else the linear logit of its features as they are."""
    explicit = F.coalesce(variant_number(record, "$.feature_logit"), F.lit(0.0))
    present = F.try_variant_get(record, "$.feature_logit", "variant").isNotNull()
    return F.when(present, explicit).otherwise(linear_logit({n: variant_number(record, f"$.{n}") for n in FEATURE_WEIGHTS}, weights))


def candidates_from_records(records: DataFrame, weights: dict[str, float] | None = None, countries: list[str] | None = None) -> DataFrame:
    """Candidate rows of records(line, record): keys, idx, platform, operator_nation, base_logit, logit, distance columns.

    A row without a platform is an error.
    """
    r = F.col("record")
    platform = first_text(r, *PLATFORM_KEYS)
    polygon = F.coalesce(*(parse_polygon(F.nullif(F.try_variant_get(r, f"$.{k}", "string"), F.lit(""))) for k in ("operator_nation_border_coordinates", "operator_country_border_coordinates", "country_border_coordinates")), *(parse_polygon(F.to_json(F.try_variant_get(r, f"$.{k}", "variant"))) for k in ("operator_nation_border_coordinates", "operator_country_border_coordinates", "country_border_coordinates")))
    rows = records.select(
        *(first_text(r, k).alias(k) for k in KEYS),
        F.col("line").alias("idx"),
        F.when(platform == "", F.raise_error(F.lit("a candidate row has no platform")).cast("string")).otherwise(platform).alias("platform"),
        first_text(r, *NATION_KEYS, default="unknown").alias("operator_nation"),
        row_logit(r, weights).alias("base_logit"),
        first_text(r, "evidence_query_id").alias("evidence_query_id"),
        first_number(r, "emitter_latitude", "emission_latitude", "latitude", "lat", "lattitude", "observed_latitude").alias("_lat"),
        first_number(r, "emitter_longitude", "emission_longitude", "longitude", "lon", "lng", "observed_longitude").alias("_lon"),
        first_number(r, "operator_nation_latitude", "operator_country_latitude", "country_latitude").alias("_own_lat"),
        first_number(r, "operator_nation_longitude", "operator_country_longitude", "country_longitude").alias("_own_lon"),
        polygon.alias("_polygon"),
    )
    out = with_distance(rows, "operator_nation", "_lat", "_lon", "_polygon", ("_own_lat", "_own_lon"), countries)
    return out.withColumn("logit", F.col("base_logit") + F.coalesce("distance_adjustment", F.lit(0.0))).withColumnsRenamed({"_lat": "emitter_latitude", "_lon": "emitter_longitude"}).drop("_own_lat", "_own_lon", "_polygon")


def group_softmax(df: DataFrame, keys: list[str], logit: str = "logit", temperature: float = 1.0) -> DataFrame:
    """df with probability: softmax of logit within the keys' groups, shifted by the group's maximum."""
    w = Window.partitionBy(*keys)
    z = F.col(logit) / F.lit(float(temperature))
    e = F.exp(z - F.max(z).over(w))
    return df.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def marginal(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys, by, p (sum of probability) and first (the smallest idx), combined before the shuffle."""
    return rows.groupBy(*keys, by).agg(F.sum("probability").alias("p"), F.min("idx").alias("first"))


def distribution(rows: DataFrame, keys: list[str], by: str, out: str) -> DataFrame:
    """keys and out: the marginal of `by`, an array of (name, p) from the likeliest down, equal ones in order of appearance."""
    m = marginal(rows, keys, by)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), F.col("first").alias("i"), F.col(by).alias("name"), F.col("p").alias("p")))), lambda x: F.struct(x["name"].alias("name"), x["p"].alias("p")))
    return m.groupBy(*keys).agg(ordered.alias(out))


def probability_records(candidates: DataFrame, keys: list[str] = KEYS, temperature: float = 1.0, on_unknown: str = "raise", model: dict | None = None) -> DataFrame:
    """One row for each group of candidates(keys, idx, platform, operator_nation, logit): distributions and top picks.

    The top platform comes from the marginal, not from the best row. The top nation is the likeliest that identifies
    one; a group without any is an error, or null with on_unknown="null". With a model its temperature counts; its
    classes must be the platforms in order where these are distinct and as many.
    """
    if model:
        temperature = model["temperature"]
        if len(set(model["classes"])) == len(model["classes"]):
            names = F.transform(F.array_sort(F.collect_list(F.struct("idx", "platform"))), lambda x: x["platform"])
            fixed = F.array(*(F.lit(c) for c in model["classes"]))
            g = candidates.groupBy(*keys).agg(names.alias("n"))
            if not g.filter((F.size("n") == len(model["classes"])) & (F.size(F.array_distinct("n")) == F.size("n")) & (F.col("n") != fixed)).isEmpty():
                raise ValueError("the model's classes are not the platforms in order")
    rows = group_softmax(candidates, keys, temperature=temperature)
    extra = [c for c in ("base_logit", "evidence_query_id", "distance_km", "distance_score", "distance_reference", "reference_lat", "reference_lon") if c in rows.columns]
    one = F.struct((-F.col("probability")).alias("n"), F.col("idx"), F.col("platform"), F.col("operator_nation"), F.col("probability"), F.col("logit"), *extra)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    platforms, nations = distribution(rows, keys, "platform", "platform_probabilities"), distribution(rows, keys, "operator_nation", "operator_nation_probabilities")
    out = listed.join(platforms, keys).join(nations, keys)
    top = F.try_element_at(F.filter("operator_nation_probabilities", lambda x: ~is_unknown_nation(x["name"])), F.lit(1))
    if on_unknown == "raise":
        top = F.when(top.isNull(), F.raise_error(F.lit("no candidate names an operator nation")).cast("struct<name:string,p:double>")).otherwise(top)
    out = out.withColumn("_top", top)
    return out.select(
        F.lit(PROBABILITY_SCHEMA).alias("schema"),
        *keys,
        F.col("platform_probabilities")[0]["name"].alias("top_platform"),
        F.col("platform_probabilities")[0]["p"].alias("top_platform_probability"),
        F.col("_top.name").alias("top_operator_nation"),
        F.col("_top.p").alias("top_operator_nation_probability"),
        "platform_probabilities",
        "operator_nation_probabilities",
        F.transform("candidates", lambda x: x.dropFields("n")).alias("candidates"),
        F.lit("temperature_scaling" if model else "softmax_uncalibrated_baseline").alias("calibration"),
    )


def padded_features(df: DataFrame, keys: list[str], order: list[Column], features: list[str], top: int = 50) -> DataFrame:
    """keys, rows (an array of exactly `top` arrays of the features, zeros for null and for padding) and n (rows used):
    the first `top` rows of each group by order."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= top)
    row = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    listed = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", row.alias("x")))), lambda s: s["x"]).alias("rows"))
    blank = F.array(*(F.lit(0.0) for _ in features))
    return listed.select(*keys, F.concat("rows", F.array_repeat(blank, F.lit(top) - F.size("rows"))).alias("rows"), F.size("rows").alias("n"))
