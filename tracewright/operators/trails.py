"""Bounded undirected trails, and the features of a contact's neighbourhood.

A trail uses no edge twice; nodes may come again. Trails are unrolled joins on a bidirectional edge table, hop by hop,
so that filters on types and starts come before them. Flags over a trail's edges are carried along, not looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed import FEATURE_SCHEMA, SUPPORT_TYPES
from tracewright.functions.probability import contradiction_ratio, recency
from tracewright.functions.values import bounded, evidence_query_id, non_negative, optional_double
from tracewright.llm.common import cut

SCORES = ["mean_source_reliability", "recency", "emission_match_score", "kinematic_match_score", "contradiction_score"]
COUNTS = ["supporting_path_count", "contradicting_path_count", "shortest_path_to_platform_class"]
ENDS = ["Entity", "PlatformClass", "CandidateIdentity"]


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge in both directions, a self-loop once."""
    there = edges.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), *columns)
    return there.unionByName(edges.filter("src <> dst").select("eid", F.col("dst").alias("a"), F.col("src").alias("b"), *columns))


def trails(starts: DataFrame, edges: DataFrame, hops: int = 4, types: list[str] | None = None, flags: dict[str, Column] | None = None, list_types: bool = False) -> DataFrame:
    """start, node, length, eids of all trails of 1 to hops edges from starts(start).

    types: the only edge types to walk. flags: name to a condition on edges(type, predicate); a trail has the flag if
    any of its edges does. With list_types also `types`, those of its edges in order.
    """
    own = edges.filter(F.col("type").isin(types)) if types else edges
    for name, condition in (flags or {}).items():
        own = own.withColumn(name, F.coalesce(condition, F.lit(False)))
    step = both_ways(own, *(flags or {}), *(["type"] if list_types else []))
    out, at = None, starts.select("start", F.col("start").alias("node"), F.array().cast("array<string>").alias("eids"), *(F.lit(False).alias(n) for n in flags or {}), *([F.array().cast("array<string>").alias("types")] if list_types else []))
    for k in range(1, hops + 1):
        nxt = step.withColumnsRenamed({n: f"_{n}" for n in (*(flags or {}), "eid")})
        at = at.join(nxt, F.col("node") == F.col("a")).filter(~F.array_contains("eids", F.col("_eid")))
        at = at.select("start", F.col("b").alias("node"), F.array_append("eids", F.col("_eid")).alias("eids"), *((F.col(n) | F.col(f"_{n}")).alias(n) for n in flags or {}), *([F.array_append("types", F.col("type")).alias("types")] if list_types else []))
        own_hop = at.withColumn("length", F.lit(k))
        out = own_hop if out is None else out.unionByName(own_hop)
    return out


def _profiles(roots: DataFrame, core: DataFrame, held: DataFrame, hops: int) -> DataFrame:
    """start, length from 0 to hops, n and ends of the trails from roots(start) over core edges, and perhaps one edge to a
    leaf at the end; own and own_end: how many of them end at any one leaf of the start itself, and whether any does.
    """
    at = roots.select("start", F.col("start").alias("node"), F.lit(0).alias("length"))
    if hops:
        at = at.unionByName(trails(roots, core, hops).select("start", "node", "length"))
    at = at.groupBy("start", "length", "node").agg(F.count("*").alias("n"))
    back, none = F.col("node") == F.col("start"), F.lit(0).cast("long")
    inner = at.select("start", "length", "n", F.col("node").isNotNull().cast("long").alias("ends"), none.alias("own"), none.alias("own_end"))
    outer = at.filter(F.col("length") < hops).join(held, F.col("node") == F.col("hub"))
    outer = outer.select("start", (F.col("length") + 1).alias("length"), (F.col("n") * F.col("leaves")).alias("n"), F.col("leaves").alias("ends"), F.when(back, F.col("n")).otherwise(none).alias("own"), back.cast("long").alias("own_end"))
    return inner.unionByName(outer).groupBy("start", "length").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "own", "own_end")))


def trail_counts(starts: DataFrame, edges: DataFrame, hops: int = 4, types: list[str] | None = None) -> DataFrame:
    """start, length, n, ends: the number of trails() of each length, and of the nodes they end at; exact.

    Trails that begin or end at a leaf are not listed. A leaf is a node whose one edge leads to a node with more, its hub;
    trails meet it only at their ends. So only trails between other nodes are listed, from starts and from hubs of starts;
    leaves at their ends are counted by hub, and the trails from a leaf are those from its hub, one edge longer, less those
    that end at the leaf itself. Trails between other nodes grow with their degrees among each other.
    """
    own = (edges.filter(F.col("type").isin(types)) if types else edges).filter("eid is not null")
    degree = both_ways(own).groupBy("a").agg(F.count("*").alias("degree"), F.min("eid").alias("eid"), F.min("b").alias("hub"))
    once = own.groupBy("eid").agg(F.count("*").alias("k")).filter("k = 1")
    hubs = degree.filter("degree > 1").select(F.col("a").alias("hub"))
    found = degree.filter("degree = 1").join(once, "eid", "left_semi").join(hubs, "hub", "left_semi").select(F.col("a").alias("leaf"), "eid", "hub")
    # Stored in the shared folder, as every hop reads it.
    marked = cut(own.select("eid", "src", "dst").join(found, "eid", "left"))
    core, leaves = marked.filter("leaf is null"), marked.filter("leaf is not null").select("leaf", "hub")
    held = leaves.groupBy("hub").agg(F.count("*").alias("leaves"))
    asked = starts.groupBy("start").agg(F.count("*").alias("times"))
    plain = asked.join(leaves, F.col("start") == F.col("leaf"), "left_anti")
    counts = plain.join(_profiles(plain.select("start"), core, held, hops), "start").filter("length > 0").select("start", "length", F.col("n") * F.col("times"), "ends")
    at_leaf = asked.join(leaves, F.col("start") == F.col("leaf")).select(F.col("start").alias("leaf"), "times", F.col("hub").alias("start"))
    longer = at_leaf.join(_profiles(at_leaf.select("start").distinct(), core, held, hops - 1), "start").filter("n > own")
    longer = longer.select("leaf", F.col("length") + 1, (F.col("n") - F.col("own")) * F.col("times"), F.col("ends") - F.col("own_end"))
    return counts.union(longer).toDF("start", "length", "n", "ends")


def neighbourhood_features(requests: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """Raw features for requests(scenario_id, contact_id, observation_time, hypothesis), all in one plan.

    Trails are walked once a contact and shared by its hypotheses. Supporting ones end at an entity, class or candidate
    whose name (or id) is the hypothesis and use a supporting edge; contradicting ones end at any such node and use a
    contradicting edge. Observations, sources and emissions are averaged on their own: what the cross product of the
    optional matches would give, without it. Unknown contacts have zeros everywhere; known ones without observations
    reliability and recency 0.5.
    """
    contacts = requests.select("contact_id").distinct().join(nodes.filter(F.array_contains("labels", "Contact")).select(F.col("id").alias("contact_id")), "contact_id")
    flags = {"supports": F.col("type").isin(SUPPORT_TYPES), "contradicts": (F.col("type") == "CONTRADICTS") | F.startswith(F.coalesce("predicate", F.lit("")), F.lit("CONTRADICT"))}
    walked = trails(contacts.select(F.col("contact_id").alias("start")), edges, hops, flags=flags).filter("supports or contradicts")
    ends = nodes.filter(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in ENDS)))).select(F.col("id").alias("node"), F.coalesce("name", "id").alias("end_name"))
    found = walked.join(ends, "node")
    support = found.filter("supports").groupBy(F.col("start").alias("contact_id"), F.col("end_name").alias("hypothesis")).agg(F.count("*").alias("supporting_path_count"), F.min("length").alias("shortest_path_to_platform_class"))
    contradict = found.filter("contradicts").groupBy(F.col("start").alias("contact_id")).agg(F.count("*").alias("contradicting_path_count"))

    link = lambda kind, a, b: edges.filter(F.col("type") == kind).select(F.col("src").alias(a), F.col("dst").alias(b))
    prop = lambda k: optional_double(F.try_element_at("props", F.lit(k)))
    labelled = lambda label: nodes.filter(F.array_contains("labels", label))
    # Observations and, where they have any, their sources.
    obs = labelled("Observation").select(F.col("id").alias("obs"), prop("age_seconds").alias("age"), F.arrays_overlap(F.map_keys("props"), F.array(F.lit("heading"), F.lit("speed"), F.lit("altitude"))).alias("moves"))
    src = labelled("Source").select(F.col("id").alias("source"), prop("reliability").alias("s_rel"), prop("confidence").alias("s_conf"))
    seen = link("HAS_OBSERVATION", "contact_id", "obs").join(contacts, "contact_id", "left_semi").join(obs, "obs")
    seen = seen.join(link("DERIVED_FROM", "obs", "source").join(src, "source"), "obs", "left")
    reliability = F.coalesce("s_rel", "s_conf", F.lit(0.5))
    seen = seen.groupBy("contact_id").agg(F.avg(reliability).alias("mean_source_reliability"), F.avg(recency(F.col("age"))).alias("recency"), F.avg(F.when(F.col("moves"), 0.5).otherwise(0.0)).alias("kinematic_match_score"))
    emissions = link("EMITTED", "contact_id", "e").join(labelled("Emission").select(F.col("id").alias("e"), F.try_element_at("props", F.lit("sensor_name")).alias("sensor_name")), "e")
    emissions = emissions.join(requests.select("contact_id", "hypothesis").distinct(), "contact_id")
    matched = emissions.groupBy("contact_id", "hypothesis").agg(F.max(F.when(F.contains(F.lower("sensor_name"), F.lower("hypothesis")), 1.0).otherwise(0.0)).alias("emission_match_score"))

    out = requests.join(contacts.withColumn("known", F.lit(True)), "contact_id", "left").join(support, ["contact_id", "hypothesis"], "left").join(contradict, "contact_id", "left").join(seen, "contact_id", "left").join(matched, ["contact_id", "hypothesis"], "left")
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    half = lambda c: F.coalesce(F.col(c), F.when(F.col("known"), 0.5).otherwise(0.0))
    return out.select(
        "scenario_id", "contact_id", "observation_time", "hypothesis",
        n("supporting_path_count").alias("supporting_path_count"), n("contradicting_path_count").alias("contradicting_path_count"),
        half("mean_source_reliability").alias("mean_source_reliability"), half("recency").alias("recency"),
        n("shortest_path_to_platform_class").alias("shortest_path_to_platform_class"), n("emission_match_score").alias("emission_match_score"),
        n("kinematic_match_score").alias("kinematic_match_score"),
        contradiction_ratio(n("supporting_path_count"), n("contradicting_path_count")).alias("contradiction_score"),
    )


def normalise_features(rows: DataFrame) -> DataFrame:
    """The feature contract: counts not negative, scores within 0 to 1 (bad values 0), query id and schema filled in.

    Feature columns may be texts or numbers, or be missing.
    """
    have = lambda c: optional_double(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("double")
    keys = [F.col(k).cast("string") for k in ("scenario_id", "contact_id", "observation_time", "hypothesis")]
    default = evidence_query_id(*keys)
    given = F.coalesce(F.nullif(F.col("evidence_query_id"), F.lit("")), default) if "evidence_query_id" in rows.columns else default
    order = ["supporting_path_count", "contradicting_path_count", "mean_source_reliability", "recency", "shortest_path_to_platform_class", "emission_match_score", "kinematic_match_score", "contradiction_score"]
    values = [(non_negative if c in COUNTS else bounded)(have(c)).alias(c) for c in order]
    return rows.select("scenario_id", "contact_id", "observation_time", "hypothesis", *values, given.alias("evidence_query_id"), F.lit(FEATURE_SCHEMA).alias("schema"))
