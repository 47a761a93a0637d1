"""Emission observations from log lines, and their part of the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed import OBSERVATION_ID_KIND, OBSERVATION_SCHEMA, OBSERVATION_SOURCE
from tracewright.functions.values import coerced, node_id, optional_bool, optional_double, python_text, stable_id
from tracewright.sources.logs import has_mark, key_values

DOUBLES = ["emission_age", "emission_latitude", "emission_longitude", "emission_heading", "emission_altitude", "emission_speed"]
MIXED = ["emission_type", "emission_role", "emission_classificationlevel"]


def parse_observations(lines: DataFrame) -> DataFrame:
    """One row for each observation in lines(line, text); lines without the mark or a required field are left out.

    Fields that can be number or text (time, type, role, level) are VARIANT; time_text is the text of the time.
    """
    own = lines.filter(has_mark(F.col("text"))).withColumn("f", key_values(F.col("text")))
    get = lambda name: F.try_element_at("f", F.lit(name))
    needed = ["Time", "Sensor_aircraft", "Emission_sensor_name"]
    for n in needed:
        own = own.filter(F.coalesce(get(n), F.lit("")) != "")
    text = lambda name: F.coalesce(python_text(get(name)), F.lit(""))
    source = lambda name: name[0].upper() + name[1:]
    return own.select(
        stable_id(OBSERVATION_ID_KIND, *(text(n) for n in needed), text("Emission_latitude"), text("Emission_longitude"), F.coalesce(F.nullif(F.col("line").cast("string"), F.lit("0")), F.lit(""))).alias("observation_id"),
        coerced(get("Time")).alias("time"),
        text("Time").alias("time_text"),
        text("Sensor_aircraft").alias("sensor_aircraft"),
        text("Emission_sensor_name").alias("emission_sensor_name"),
        *(optional_double(get(source(n))).alias(n) for n in DOUBLES),
        optional_bool(get("Emission_solid")).alias("emission_solid"),
        *(coerced(get(source(n))).alias(n) for n in MIXED),
        text("Emission_target_type").alias("emission_target_type"),
        F.col("line").alias("source_line"),
        F.lit(OBSERVATION_SOURCE).alias("source"),
        F.lit(OBSERVATION_SCHEMA).alias("schema"),
    )


def _ids(o: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.col(c))
    return (
        o.withColumn("contact_id", node_id("contact", F.col("observation_id")))
        .withColumn("sensor_id", node_id("sensor", low("emission_sensor_name")))
        .withColumn("platform_id", node_id("platform", low("sensor_aircraft")))
        .withColumn("emission_id", node_id("emission", F.col("observation_id"), low("emission_sensor_name")))
        .withColumn("class_id", F.when(F.col("emission_target_type") != "", node_id("platform-class", low("emission_target_type"))))
        .withColumn("source_id", node_id("source", F.col("source"), F.coalesce(F.col("source_line").cast("string"), F.lit(""))))
    )


def observation_graph(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, labels, name, aliases, props) and edges(src, dst, type, props) of observations, each once.

    props are maps of texts. Of nodes seen more than once the last line's name counts. Observations without a class have
    no class node.
    """
    o = _ids(observations)

    def props(**fields: Column) -> Column:
        pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")

    level = F.to_json("emission_classificationlevel")
    locator = F.when(F.col("source_line") > 0, F.concat(F.lit("line:"), F.col("source_line"))).otherwise("log")
    node = lambda i, label, name, p: F.struct(i.alias("id"), F.array(F.lit(label)).alias("labels"), name.alias("name"), p.alias("props"))
    contact_name = F.concat(F.lit("Contact observed at "), F.col("time_text"), F.lit(" by "), F.col("sensor_aircraft"))
    none = F.lit(None).cast("string")
    seen = props(time=F.col("time_text"), source=F.col("source"), source_line=F.col("source_line"), age_seconds=F.col("emission_age"), solid=F.col("emission_solid"), latitude=F.col("emission_latitude"), longitude=F.col("emission_longitude"), heading=F.col("emission_heading"), altitude=F.col("emission_altitude"), speed=F.col("emission_speed"), classification_level=level)
    nodes = F.array(
        node(F.col("observation_id"), "Observation", none, seen),
        node(F.col("contact_id"), "Contact", contact_name, props()),
        node(F.col("platform_id"), "Platform", F.col("sensor_aircraft"), props()),
        node(F.col("sensor_id"), "Sensor", F.col("emission_sensor_name"), props()),
        node(F.col("emission_id"), "Emission", none, props(sensor_name=F.col("emission_sensor_name"), type=F.to_json("emission_type"), role=F.to_json("emission_role"))),
        node(F.col("source_id"), "Source", none, props(source_type=F.col("source"), locator=locator)),
        node(F.col("class_id"), "PlatformClass", F.col("emission_target_type"), props()),
    )
    edge = lambda a, b, kind, p: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"), p.alias("props"))
    edges = F.array(
        edge("contact_id", "observation_id", "HAS_OBSERVATION", props()),
        edge("observation_id", "platform_id", "OBSERVED_BY", props()),
        edge("platform_id", "sensor_id", "DETECTS", props()),
        edge("contact_id", "emission_id", "EMITTED", props()),
        edge("emission_id", "sensor_id", "DETECTED_BY", props()),
        edge("observation_id", "source_id", "DERIVED_FROM", props()),
        edge("contact_id", "class_id", "CLASSIFIED_AS", props(level=level)),
    )
    n = o.select(F.col("source_line").alias("seq"), F.explode(nodes).alias("x")).select("seq", "x.*").filter("id is not null")
    # Maps cannot be compared: the latest row is kept by its place.
    n = n.groupBy("id", "labels").agg(F.max_by(F.struct("name", "props"), F.col("seq")).alias("x")).select("id", "labels", "x.name", F.array().cast("array<string>").alias("aliases"), "x.props")
    e = o.select(F.explode(edges).alias("x")).select("x.*").filter("dst is not null")
    e = e.groupBy("src", "dst", "type", F.to_json("props").alias("p")).agg(F.first("props").alias("props")).select("src", "dst", "type", "props")
    return n, e


def temporal_edges(observations: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """src, dst and type: each observation precedes the next of the same `by`, which follows it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() for c in order), F.col(node))
    following = observations.select(F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).filter("dst is not null")
    precedes = following.withColumn("type", F.lit("observation_precedes_observation"))
    return precedes.unionByName(following.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("observation_follows_observation").alias("type")))
