"""Hypotheses for emitters: from names over the graph to ranked platforms and operator nations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions.names import (
    emitter_aliases,
    emitter_match,
    emitter_matches,
    evidence_path_id,
    match_terms,
    nation_terms,
    relationship_types,
    safe_substring,
    semantic_tokens,
    spaced,
    upper_bound,
    valid_candidate,
    variant_without_nation,
)
from tracewright.functions.values import stable_id, strip
from tracewright.operators.trails import both_ways, trails


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _label(any_of: list[str], none_of: list[str] = ()) -> Column:
    out = F.arrays_overlap("labels", _texts(list(any_of)))
    return out & ~F.arrays_overlap("labels", _texts(list(none_of))) if none_of else out


NO_PLATFORM = ["Country", "Sensor", "Operator", "Location"]


def _grams(text: Column, n: int) -> Column:
    """All parts of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def matched_emitters(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """observation_id, emitter, emitter_name and score of the nodes that match an observation's emitter name.

    Names repeat over observations, so distinct names are matched and joined back. A text that contains another has the
    other's first three letters somewhere: these are the keys that bring pairs together, which are then checked.
    """
    names = observations.select("emission_sensor_name").distinct()
    aliases = emitter_aliases(F.col("emission_sensor_name"))
    names = names.withColumn("aliases", aliases).select("emission_sensor_name", match_terms(F.col("aliases")).alias("terms"), semantic_tokens(F.col("aliases")).alias("tokens"))
    own = nodes.select(F.col("id").alias("emitter"), F.coalesce("name", "id").alias("emitter_name"), "labels").withColumn("spaced", spaced(F.coalesce("emitter_name", F.lit(""))))
    known, asked = own.select("spaced").distinct(), names.select("emission_sensor_name", "terms", F.array_union("terms", "tokens").alias("texts"))
    within = known.select("spaced", F.explode(F.array_distinct(F.flatten(F.array(*(_grams(F.col("spaced"), n) for n in (1, 2, 3)))))).alias("gram"))
    first = asked.select("emission_sensor_name", F.explode(F.array_distinct(F.transform("texts", lambda t: F.substring(t, 1, 3)))).alias("gram"))
    reverse = asked.select("emission_sensor_name", F.explode(F.array_distinct(F.flatten(F.transform("terms", lambda t: _grams(t, 3))))).alias("gram"))
    met = first.join(within, "gram").unionByName(reverse.join(known.select("spaced", F.substring("spaced", 1, 3).alias("gram")), "gram")).select("emission_sensor_name", "spaced").distinct()
    exact, matched = emitter_match(F.col("spaced"), F.col("terms"), F.col("tokens"))
    found = met.join(names, "emission_sensor_name").filter(emitter_matches(exact, matched, F.col("tokens")))
    pairs = own.join(found, "spaced").withColumn("score", (F.size(exact) * 10 + F.size(matched)).cast("double"))
    return observations.select("observation_id", "emission_sensor_name").join(pairs.select("emission_sensor_name", "emitter", "emitter_name", "score"), "emission_sensor_name")


def _near(edges: DataFrame, types: list[str], ends: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) over edges of the types in either direction, with b among ends(id, labels, name)."""
    pairs = both_ways(edges.filter(F.col("type").isin(types))).select(F.col("a").alias(a), F.col("b").alias(b))
    return pairs.join(ends.select(F.col("id").alias(b), F.col("name").alias(f"{b}_name"), F.col("labels").alias(f"{b}_labels")), b)


def _facts(edges: DataFrame, predicates: list[str], ends: DataFrame, a: str, b: str) -> DataFrame:
    own = edges.filter((F.col("type") == "FACT") & F.col("predicate").isin(predicates)).withColumn("type", F.lit("FACT"))
    return _near(own, ["FACT"], ends, a, b)


def _variants(nodes: DataFrame, edges: DataFrame, types: list[str], allowed: Column, a: str, b: str) -> DataFrame:
    """A node and itself, and its neighbours over edges of the types; b must be allowed."""
    ends = nodes.filter(allowed)
    pairs = both_ways(edges.filter(F.col("type").isin(types))).select(F.col("a").alias(a), F.col("b").alias(b)).unionByName(nodes.select(F.col("id").alias(a), F.col("id").alias(b)))
    return pairs.join(ends.select(F.col("id").alias(b), F.col("name").alias(f"{b}_name"), F.col("labels").alias(f"{b}_labels")), b)


def graph_rows(observations: DataFrame, nodes: DataFrame, edges: DataFrame, whitelist: list[str] | None = None, hops: int = 4) -> DataFrame:
    """Candidate rows for observations(observation_id, emission_sensor_name), all in one plan.

    Platforms within `hops` edges of a matched emitter; variants of both; operators and countries by a cascade in which
    those of the platform's variant count only where the row has no country of the platform's own; kinematic facts. Rows
    of one observation are grouped by names and labels, not by nodes.
    """
    types = relationship_types(whitelist)
    named = nodes.select("id", "labels", F.coalesce("name", "id").alias("name"))
    emitters = matched_emitters(observations, named)
    # Distinct emitters are walked once, whatever the number of observations.
    walked = trails(emitters.select(F.col("emitter").alias("start")).distinct(), edges, hops, types=types or None, list_types=True)
    platforms = named.filter(_label(["Platform", "Aircraft"], NO_PLATFORM)).select(F.col("id").alias("platform"), F.col("name").alias("platform_name"), F.col("labels").alias("platform_labels"))
    paths = walked.join(platforms, walked["node"] == platforms["platform"]).select(F.col("start").alias("emitter"), "platform", "platform_name", "platform_labels", F.reverse("types").alias("types"), F.array_join("eids", ">").alias("path"))
    paths = paths.groupBy("emitter", "platform", "platform_name", "platform_labels").agg(F.collect_set("types").alias("paths"), F.collect_set("path").alias("path_ids"))

    rows = emitters.join(paths, "emitter")
    rows = rows.join(_variants(named, edges, fixed.VARIANT_TYPES, _label(["Platform", "Aircraft"], NO_PLATFORM), "platform", "variant"), "platform", "left")
    rows = rows.join(_variants(named, edges, fixed.EMITTER_VARIANT_TYPES, _label(["Sensor", "Entity"]), "emitter", "emitter_variant"), "emitter", "left")
    operators, countries = named.filter(_label(["Operator"])), named.filter(_label(["Country"]))
    rows = rows.join(_near(edges, fixed.OPERATOR_TYPES, operators, "platform", "operator"), "platform", "left")
    rows = rows.join(_near(edges, fixed.COUNTRY_TYPES, countries, "platform", "country"), "platform", "left")
    rows = rows.join(_near(edges, fixed.COUNTRY_VIA_OPERATOR_TYPES, countries, "operator", "via"), "operator", "left")
    rows = rows.join(_facts(edges, fixed.OPERATOR_FACTS, operators, "platform", "fact_operator"), "platform", "left")
    rows = rows.join(_near(edges, fixed.COUNTRY_VIA_OPERATOR_TYPES, countries, "fact_operator", "fact_country"), "fact_operator", "left")
    # From here on only for rows without a country of the platform's own; the gate is a null key.
    gate = F.col("country").isNull() & F.col("via").isNull()
    later = gate & F.col("fact_country").isNull()

    def gated(rows: DataFrame, key: str, when: Column, right: DataFrame, a: str) -> DataFrame:
        return rows.withColumn("_k", F.when(when, F.col(key))).join(right.withColumnRenamed(a, "_k"), "_k", "left").drop("_k")

    rows = gated(rows, "variant", gate, _near(edges, fixed.OPERATOR_TYPES, operators, "x", "v_operator"), "x")
    rows = gated(rows, "variant", gate, _near(edges, fixed.COUNTRY_TYPES, countries, "x", "v_country"), "x")
    rows = gated(rows, "v_operator", gate, _near(edges, fixed.COUNTRY_VIA_OPERATOR_TYPES, countries, "x", "v_via"), "x")
    rows = gated(rows, "variant", later, _facts(edges, fixed.OPERATOR_FACTS, operators, "x", "v_fact_operator"), "x")
    rows = gated(rows, "v_fact_operator", later, _near(edges, fixed.COUNTRY_VIA_OPERATOR_TYPES, countries, "x", "v_fact_country"), "x")

    empty = F.array().cast("array<string>")
    cascade = ["country", "via", "fact_country", "v_country", "v_via", "v_fact_country"]
    held = ["operator", "fact_operator", "v_operator", "v_fact_operator"]
    rows = rows.select(
        "observation_id", "emitter_name", "score", "paths", "path_ids", "platform", "variant",
        F.col("platform_name").alias("hypothesis"), F.coalesce("variant_name", "platform_name").alias("aircraft_variant"), F.coalesce("emitter_variant_name", "emitter_name").alias("emitter_variant_out"),
        F.coalesce(*(f"{c}_name" for c in cascade), F.lit("Unknown")).alias("operator_nation"),
        "platform_labels", F.coalesce("variant_labels", empty).alias("aircraft_variant_labels"), F.coalesce(*(f"{c}_labels" for c in held), empty).alias("operator_labels"), F.coalesce(*(f"{c}_labels" for c in cascade), empty).alias("operator_country_labels"),
    )
    facts = edges.filter((F.col("type") == "FACT") & F.col("predicate").isin(fixed.SPEED_FACTS + fixed.ALTITUDE_FACTS)).join(named.select(F.col("id").alias("dst"), F.col("name").alias("value")), "dst")
    # The few values of each predicate, listed once for each subject.
    values = facts.groupBy(F.col("src").alias("subject")).agg(*(F.collect_set(F.when(F.col("predicate") == p, F.col("value"))).alias(f"{p.lower()}_values") for p in fixed.SPEED_FACTS + fixed.ALTITUDE_FACTS))
    lists = [f"{p.lower()}_values" for p in fixed.SPEED_FACTS + fixed.ALTITUDE_FACTS]
    rows = rows.join(values.withColumnsRenamed({"subject": "platform"} | {c: f"p_{c}" for c in lists}), "platform", "left").join(values.withColumnsRenamed({"subject": "variant"} | {c: f"v_{c}" for c in lists}), "variant", "left")
    keys = ["observation_id", "hypothesis", "operator_nation", "aircraft_variant", "emitter_variant_out", "platform_labels", "aircraft_variant_labels", "operator_labels", "operator_country_labels"]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.coalesce(f"p_{c}", empty), F.coalesce(f"v_{c}", empty))))))
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set("emitter_name")).alias("matched_aliases"),
        F.size(F.array_distinct(F.flatten(F.collect_set("path_ids")))).cast("long").alias("support_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("evidence_paths"),
        F.max("score").alias("semantic_match_score"),
        *(union(c).alias(c) for c in lists),
    )
    return out.withColumnRenamed("emitter_variant_out", "emitter_variant")


def top_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The best `limit` rows of each observation, and their rank."""
    w = Window.partitionBy("observation_id").orderBy(F.col("semantic_match_score").desc(), F.col("support_count").desc(), *(F.col(c).asc_nulls_last() for c in ("hypothesis", "operator_nation", "aircraft_variant", "emitter_variant")))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def hypotheses(rows: DataFrame, observations: DataFrame, n: int, countries: list[str] | None = None) -> DataFrame:
    """At most n hypotheses for each observation from graph rows: the best 4n are fetched, checked, and cut to n.

    So fewer than n may be left although more valid rows exist below. Unknown upper bounds of ranges are null.
    """
    terms = nation_terms(countries if countries is not None else fixed.default_countries())
    top = top_rows(rows, max(4 * n, n))
    valid = valid_candidate(F.col("platform_labels"), F.col("aircraft_variant_labels"), F.col("operator_nation"), F.col("operator_labels"), F.col("operator_country_labels"))
    kept = top.filter(valid & (strip(F.coalesce("hypothesis", F.lit(""))) != "")).withColumn("hypothesis", strip(F.col("hypothesis")))
    variant, inferred = variant_without_nation(F.col("aircraft_variant"), F.col("hypothesis"), terms)
    given = F.coalesce(F.nullif(strip(F.coalesce("operator_nation", F.lit(""))), F.lit("")), F.lit("Unknown"))
    unknown = F.upper(given).isin(fixed.UNKNOWN_GRAPH_NATIONS)
    w = Window.partitionBy("observation_id").orderBy("rank")
    kept = kept.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
    lists = lambda names: [F.col(f"{p.lower()}_values") for p in names]
    span = lambda names, units: F.array(F.lit(0.0), upper_bound(lists(names), units))
    out = kept.select(
        "observation_id", "nth", "hypothesis",
        F.when(unknown & inferred.isNotNull(), inferred).otherwise(given).alias("operator_nation"),
        variant.alias("aircraft_variant"), F.coalesce("emitter_variant", F.lit("")).alias("emitter_variant"), F.col("matched_aliases").alias("emitter_aliases"),
        span(fixed.SPEED_FACTS, ["kt", "kts", "knot", "knots"]).alias("typical_speed_kt"), span(fixed.ALTITUDE_FACTS, ["m", "meter", "meters"]).alias("typical_altitude_m"),
        F.coalesce("support_count", F.lit(0)).cast("long").alias("kg_support_count"), "evidence_paths", F.coalesce("semantic_match_score", F.lit(0.0)).alias("semantic_match_score"),
    )
    if "emission_target_type" in observations.columns:
        out = out.join(observations.select("observation_id", F.col("emission_target_type").alias("platform_class")), "observation_id")
    return out


def in_range(value: Column, span: Column) -> Column:
    """1 within the range, else 0; also 0 for an unknown value or bound (null or NaN)."""
    low, high = span[0], span[1]
    ok = (low <= value) & (value <= high) & ~F.isnan(low) & ~F.isnan(high) & ~F.isnan(value)
    return F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def offline_score(name: Column, target: Column, speed: Column, altitude: Column) -> Column:
    """Compatibility of a candidate row with an observation: support, aliases, class, speed and altitude."""
    low = F.lower(F.coalesce(name, F.lit("")))
    aliases = F.transform("emitter_aliases", F.lower)
    observed, own = semantic_tokens(F.array(low)), semantic_tokens(aliases)
    shared = F.when(F.size(own) > 0, F.size(F.array_intersect(observed, own)) / F.size(own)).otherwise(0.0)
    alias = F.greatest(F.when(F.exists(aliases, lambda a: safe_substring(a, low)), 1.0).otherwise(0.0), shared)
    same_class = F.when((F.coalesce(target, F.lit("")) != "") & (target == F.col("platform_class")), 1.0).otherwise(0.0)
    support = F.log1p(F.greatest(F.coalesce(F.col("kg_support_count").cast("double"), F.lit(0.0)), F.lit(0.0)))
    return support + alias * 3.0 + same_class + in_range(speed, F.coalesce("typical_speed_kt", F.array(F.lit(0.0), F.lit(2500.0)))) + in_range(altitude, F.coalesce("typical_altitude_m", F.array(F.lit(0.0), F.lit(25000.0))))


def select_offline(observations: DataFrame, candidates: DataFrame, n: int, order: str = "nth") -> DataFrame:
    """The n best distinct candidates of each observation: by score, then by names, all descending, then as given.

    Of rows with one identity (hypothesis, nation, variants) the best stays; blank hypotheses go.
    """
    o = observations.select("observation_id", "emission_sensor_name", "emission_target_type", "emission_speed", "emission_altitude")
    rows = candidates.join(o, "observation_id").withColumn("score", offline_score(F.col("emission_sensor_name"), F.col("emission_target_type"), F.col("emission_speed"), F.col("emission_altitude")))
    t = lambda c, alt=None: strip(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), alt if alt is not None else F.lit("")))
    hyp = t("hypothesis")
    rows = rows.filter(hyp != "").withColumn("_i", F.struct(hyp.alias("a"), t("operator_nation").alias("b"), t("aircraft_variant", F.col("hypothesis")).alias("c"), t("emitter_variant").alias("d")))
    by = [F.col("score").desc(), F.col("hypothesis").desc(), F.col("operator_nation").desc_nulls_last(), F.col(order).asc()]
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("observation_id", "_i").orderBy(*by))).filter("_r = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("observation_id").orderBy(*by))).filter(F.col("rank") <= n).drop("_i", "_r", *o.columns[1:])


def to_feature_rows(observations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Feature rows of chosen hypotheses: a flag for a matching alias, half a point each for speed and altitude."""
    rows = chosen.join(observations.select("observation_id", F.lower("emission_sensor_name").alias("_name"), "emission_speed", "emission_altitude"), "observation_id")
    kinematic = (in_range(F.col("emission_speed"), F.col("typical_speed_kt")) + in_range(F.col("emission_altitude"), F.col("typical_altitude_m"))) / 2
    path = evidence_path_id(F.col("evidence_paths"))
    return rows.select(
        "observation_id", "hypothesis", "operator_nation", F.col("kg_support_count").cast("double").alias("supporting_path_count"), F.lit(0.0).alias("contradicting_path_count"),
        F.lit(0.75).alias("mean_source_reliability"), F.lit(1.0).alias("recency"), F.lit(1.0).alias("shortest_path_to_platform_class"),
        F.when(F.exists("emitter_aliases", lambda a: F.contains(F.col("_name"), F.lower(a))), 1.0).otherwise(0.0).alias("emission_match_score"),
        kinematic.alias("kinematic_match_score"), F.lit(0.0).alias("contradiction_score"),
        F.coalesce(F.nullif(path, F.lit("")), stable_id("hypothesis", F.col("observation_id"), F.col("hypothesis"))).alias("evidence_query_id"),
    )
