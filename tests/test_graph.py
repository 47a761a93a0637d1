import random
import threading

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph, hypotheses, observations, trails
from tracewright.plans import queries

PROPS = "map<string,string>"
NODE = f"id string, labels array<string>, name string, aliases array<string>, props {PROPS}"
EDGE = f"eid string, src string, dst string, type string, predicate string, props {PROPS}"


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame([(i, labels.split(), name, [], props) for i, labels, name, props in nodes], NODE)
    e = spark.createDataFrame([(f"e{k}", s, d, t, p, {}) for k, (s, t, d, p) in enumerate(edges)], EDGE)
    return n, e


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def lengths(df):
    return {r.length: r.n for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}


def test_triangle(spark):
    _, e = graph_of(spark, [], [("a", "X", "b", None), ("b", "X", "c", None), ("c", "X", "a", None)])
    assert lengths(trails.trails(starts(spark, "a", "b", "c"), e)) == {1: 6, 2: 6, 3: 6}


def test_self_loop_and_types(spark):
    _, e = graph_of(spark, [], [("a", "X", "a", None), ("a", "Y", "b", None)])
    got = trails.trails(starts(spark, "a"), e, 3)
    assert lengths(got) == {1: 2, 2: 1}
    assert sorted((r.node, len(r.eids)) for r in got.collect()) == [("a", 1), ("b", 1), ("b", 2)]
    assert lengths(trails.trails(starts(spark, "a"), e, 3, types=["Y"])) == {1: 1}


def test_trail_counts_are_those_of_trails(spark):
    rng = random.Random(5)
    # A pair apart, a star with a loop at its hub, a double edge, ids that are null or used twice, and random edges.
    edges = [("p", "q"), ("h", "h"), ("h", "l1"), ("l2", "h"), ("h", "l3"), ("d", "l1"), ("m", "o"), ("m", "o"), ("o", "w"), ("x", "o")]
    edges += [(f"r{rng.randrange(7)}", f"r{rng.randrange(7)}") for _ in range(9)] + [(f"r{k % 4}", f"z{k}") for k in range(9)]
    rows = [(f"e{k}", s, d, rng.choice("XXY"), None, {}) for k, (s, d) in enumerate(edges)]
    rows += [(None, "h", "n1", "X", None, {}), ("e1", "h", "n2", "X", None, {}), ("e9", "r0", "n3", "X", None, {}), ("f", "h", None, "X", None, {})]
    e = spark.createDataFrame(rows, EDGE)
    ids = sorted({x for r in rows for x in r[1:3] if x}) + ["l2", "h", "nowhere"]
    s = starts(spark, *ids, None)
    for hops, types in ((4, None), (1, None), (3, ["X"])):
        listed = trails.trails(s, e, hops, types).groupBy("start", "length").agg(F.count("*").alias("n"), F.countDistinct("node").alias("ends"))
        got = trails.trail_counts(s, e, hops, types)
        assert got.columns == listed.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))


def test_trails_1_4_with_many_suppliers(spark, tmp_path):
    """Some 16 billion trails, which nobody can list in the time given."""
    size = 200_000
    spark.range(5).selectExpr("cast(id as int) r_regionkey", "'r' r_name").write.parquet(str(tmp_path / "region.parquet"))
    spark.range(25).selectExpr("cast(id as int) n_nationkey", "cast(id % 5 as int) n_regionkey", "'n' n_name").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(size).selectExpr("id s_suppkey", "cast(id % 25 as int) s_nationkey", "'s' s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(5).selectExpr("id c_custkey", "cast(id as int) c_nationkey", "'c' c_name").write.parquet(str(tmp_path / "customer.parquet"))
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        rows = queries.trails_1_4(spark, str(tmp_path)).groupBy("length", "n", "ends").agg(F.count("*").alias("starts")).collect()
    finally:
        late.cancel()
    each = size // 25
    assert sorted(map(tuple, rows)) == [(1, 1, 1, size), (2, each, each, size), (3, 4, 4, size), (4, 4 * each, 4 * each, size)]


def features(spark, nodes, edges, requests):
    n, e = graph_of(spark, nodes, edges)
    r = spark.createDataFrame([("s", c, "t", h) for c, h in requests], "scenario_id string, contact_id string, observation_time string, hypothesis string")
    return {(x.contact_id, x.hypothesis): x for x in trails.neighbourhood_features(r, n, e).collect()}


def test_neighbourhood(spark):
    nodes = [
        ("c", "Contact", "C", {}), ("k", "PlatformClass", "Fighter", {}), ("x", "Entity", "Other", {}), ("y", "CandidateIdentity", None, {}),
        ("o1", "Observation", None, {"age_seconds": "1"}), ("o2", "Observation", None, {"altitude": "5"}), ("s1", "Source", None, {"reliability": "0.9"}), ("s2", "Source", None, {"confidence": "0.3"}),
        ("e", "Emission", None, {"sensor_name": "big FIGHTER radar"}), ("c2", "Contact", "C2", {}), ("c3", "Contact", "C3", {}),
    ]
    edges = [
        ("c", "CLASSIFIED_AS", "k", None), ("k", "CONTRADICTS", "x", None), ("x", "FACT", "y", "CONTRADICTED_BY"), ("c", "HAS_OBSERVATION", "o1", None), ("c", "HAS_OBSERVATION", "o2", None),
        ("o1", "DERIVED_FROM", "s1", None), ("o1", "DERIVED_FROM", "s2", None), ("c", "EMITTED", "e", None), ("c2", "OTHER", "k", None),
    ]
    got = features(spark, nodes, edges, [("c", "Fighter"), ("c", "Other"), ("c", "y"), ("c2", "Fighter"), ("c3", "Fighter"), ("nobody", "Fighter")])
    f = got["c", "Fighter"]
    # Contradicting trails: c-k-x and c-k-x-y.
    assert (f.supporting_path_count, f.contradicting_path_count, f.shortest_path_to_platform_class) == (1, 2, 1)
    assert f.mean_source_reliability == pytest.approx((0.9 + 0.3 + 0.5) / 3)
    assert f.recency == pytest.approx((0.5 + 0.5 + 0.5) / 3)
    assert f.kinematic_match_score == pytest.approx(0.5 / 3)
    assert f.emission_match_score == 1 and f.contradiction_score == pytest.approx(2 / 3)
    assert (got["c", "Other"].supporting_path_count, got["c", "Other"].shortest_path_to_platform_class) == (1, 2)
    assert got["c", "y"].shortest_path_to_platform_class == 3
    c2 = got["c2", "Fighter"]
    # Of c2's trails over k only one through c's own edge supports, and it does not end at the class.
    assert c2.supporting_path_count == 0 and (c2.mean_source_reliability, c2.recency, c2.kinematic_match_score) == (0.5, 0.5, 0)
    assert all(v == 0 for v in list(got["nobody", "Fighter"])[4:])


def test_normalised_features(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "2", "1.5", None, "-1", "inf")], "scenario_id string, contact_id string, observation_time string, hypothesis string, supporting_path_count string, mean_source_reliability string, kinematic_match_score string, contradiction_score string, recency string")
    r = trails.normalise_features(df).first()
    assert (r.supporting_path_count, r.mean_source_reliability, r.kinematic_match_score, r.contradiction_score, r.recency, r.emission_match_score) == (2, 1, 0, 0, 0, 0)
    assert len(r.evidence_query_id) == 16 and r.schema == "graph_neighbourhood_features_v1"


FACT = "seq long, subject string, predicate string, object string, source_id string, source_type string, locator string, evidence string, confidence double"


def facts(spark, *triples):
    return spark.createDataFrame([(i, s, p, o, "src", "web", "u", "", 0.5) for i, (s, p, o) in enumerate(triples)], FACT)


def test_fact_graph(spark):
    f = facts(
        spark, ("Mikoyan MiG-29", "USES_RADAR", "N019"), ("MiG-29", "USES_RADAR", "N019"), ("mig-29", "OPERATOR_COUNTRY", "India"), ("India", "USES_RADAR", "Zhuk-ME"), ("MiG-29", "OPERATOR_COUNTRY", "Zhuk-ME"),
        ("MiG-29", "MAX_ALTITUDE_M", "17,500 m"), ("N019", "RADAR_BAND", "X"), ("MiG-29SMT", "VARIANT_OF", "MiG-29"), ("MiG-29", "OPERATED_BY", "Air Force"),
    )
    nodes, edges = graph.fact_graph(f, ["INDIA"])
    by = {r.name: r for r in nodes.collect() if r.name}
    # The same entity in three spellings; the last one names it.
    assert "MiG-29" in by and by["MiG-29"].id == "95217cb739ecc912"
    assert set(by["MiG-29"].aliases) >= {"Mikoyan MiG-29"}
    assert by["MiG-29"].labels == ["Entity", "Platform", "ReferenceEntity"]
    assert "Sensor" in by["N019"].labels and "Sensor" in by["X"].labels
    assert by["India"].labels == ["Entity", "Country", "ReferenceEntity"]
    assert by["Zhuk-ME"].labels == ["Entity"] and "Operator" in by["Air Force"].labels
    assert "Platform" in by["MiG-29SMT"].labels and by["17,500 m"].labels == ["Entity"]
    count = {r.type: r.n for r in graph.relationship_counts(edges).collect()}
    assert count == {"FACT": 9, "MENTIONED_IN": 8, "USES_RADAR": 1, "OPERATOR_COUNTRY": 1, "RADAR_BAND": 1, "VARIANT_OF": 1, "OPERATED_BY": 1}
    assert graph.duplicate_ids(nodes).count() == 0
    merged = graph.merge_graphs((nodes, edges), (nodes, edges))
    assert merged[0].count() == nodes.count()
    assert {r.type: r.n for r in graph.relationship_counts(merged[1]).collect()} == count | {"FACT": 18}


LINE = "noise PY_CONTACT_LOG Time : {t}, Sensor_aircraft : Typhoon FGR.4, Emission_sensor_name : Slot Back [N-010 Zhuk-M], Emission_age : 3, Emission_solid : true, Emission_type : 4, Emission_role : Radar, Emission_latitude : 44.640933862914, Emission_longitude : 31.890743606263, Emission_heading : 250, Emission_altitude : {a}, Emission_speed : 480.5, Emission_target_type : Type: Multirole (Fighter), Emission_classificationlevel : 2"


def observed(spark):
    lines = [(1, LINE.format(t=1844772240, a="nil")), (2, "other line"), (3, LINE.format(t="007", a="1e3")), (4, "PY_CONTACT_LOG Time : , Sensor_aircraft : x, Emission_sensor_name : y"), (5, "PY_CONTACT_LOG Time : 1, Time : 2, Sensor_aircraft : x, Emission_sensor_name : y")]
    return observations.parse_observations(spark.createDataFrame(lines, "line long, text string"))


def test_observations(spark):
    got = {r.source_line: r for r in observed(spark).withColumn("level", F.to_json("emission_classificationlevel")).withColumn("role", F.to_json("emission_role")).collect()}
    assert sorted(got) == [1, 3, 5]
    a = got[1]
    assert a.observation_id == "13e4329885a9f92e"
    assert (a.time_text, a.emission_altitude, a.emission_speed, a.emission_solid, a.level, a.role) == ("1844772240", None, 480.5, True, "2", '"Radar"')
    assert a.emission_target_type == "Type: Multirole (Fighter)"
    assert got[3].time_text == "7" and got[3].emission_altitude == 1000.0
    assert got[5].time_text == "2" and got[5].emission_target_type == ""


def test_observation_graph(spark):
    nodes, edges = observations.observation_graph(observed(spark))
    labels = [r.labels[0] for r in nodes.collect()]
    assert {x: labels.count(x) for x in set(labels)} == {"Observation": 3, "Contact": 3, "Platform": 2, "Sensor": 2, "Emission": 3, "Source": 3, "PlatformClass": 1}
    assert "edaddfce9969c871" in [r.id for r in nodes.collect()]
    count = {r.type: r.n for r in graph.relationship_counts(edges).collect()}
    assert count == {"HAS_OBSERVATION": 3, "OBSERVED_BY": 3, "DETECTS": 2, "EMITTED": 3, "DETECTED_BY": 3, "DERIVED_FROM": 3, "CLASSIFIED_AS": 2}
    assert [r.props["level"] for r in edges.filter("type = 'CLASSIFIED_AS'").collect()] == ["2", "2"]


def hypothesis_graph(spark):
    nodes = [
        ("r", "Entity Sensor", "N010 Zhuk", {}), ("r2", "Sensor", "10", {}), ("p", "Entity Platform", "MiG-29", {}), ("v", "Platform", "MiG-29 (Romanian)", {}), ("q", "Platform", "Su-27", {}), ("bad", "Platform Country", "Land", {}),
        ("op", "Operator", "IAF", {}), ("in", "Country", "India", {}), ("ru", "Country", "Russia", {}), ("k", "Entity", "Mach 2.25 (1,320 kt)", {}), ("m", "Entity", "57,400 ft (17,500 m)", {}),
    ]
    edges = [
        ("p", "USES_RADAR", "r", None), ("p", "HAS_SENSOR", "r", None), ("q", "USES_RADAR", "r", None), ("bad", "USES_RADAR", "r", None), ("v", "VARIANT_OF", "p", None), ("p", "OPERATED_BY", "op", None), ("op", "LOCATED_IN", "in", None),
        ("v", "OPERATOR_COUNTRY", "ru", None), ("p", "FACT", "k", "MAX_SPEED_KT"), ("v", "FACT", "m", "SERVICE_CEILING_M"), ("q", "FACT", "op", "OPERATED_BY_AIRCRAFT_MODEL"),
    ]
    obs = spark.createDataFrame([("o", "Slot Back [N-010 Zhuk-M]", "Fighter", 600.0, None)], "observation_id string, emission_sensor_name string, emission_target_type string, emission_speed double, emission_altitude double")
    return obs, *graph_of(spark, nodes, edges)


def test_hypotheses(spark):
    obs, nodes, edges = hypothesis_graph(spark)
    rows = hypotheses.graph_rows(obs, nodes, edges, ["USES_RADAR", "HAS_SENSOR"], hops=4)
    got = {(r.hypothesis, r.aircraft_variant): r for r in rows.collect()}
    # The platform itself and its variant, v and p each; the row's own country (over the operator) closes the cascade.
    assert set(got) == {("MiG-29", "MiG-29"), ("MiG-29", "MiG-29 (Romanian)"), ("Su-27", "Su-27")}
    m = got["MiG-29", "MiG-29 (Romanian)"]
    # Trails of up to four edges: two direct ones; from each of them none of three, as q's single edge leads nowhere.
    assert m.operator_nation == "India" and m.operator_labels == ["Operator"] and m.operator_country_labels == ["Country"]
    assert sorted(map(tuple, m.evidence_paths)) == [("HAS_SENSOR",), ("USES_RADAR",)] and m.support_count == 2
    assert m.matched_aliases == ["N010 Zhuk"] and m.max_speed_kt_values == ["Mach 2.25 (1,320 kt)"] and m.service_ceiling_m_values == ["57,400 ft (17,500 m)"]
    assert got["Su-27", "Su-27"].operator_nation == "India"
    out = {(r.hypothesis, r.aircraft_variant, r.operator_nation): r for r in hypotheses.hypotheses(rows, obs, 5).collect()}
    assert ("MiG-29", "MiG-29", "India") in out
    best = [r for r in out.values() if r.hypothesis == "MiG-29" and r.typical_altitude_m[1]]
    assert best[0].typical_altitude_m == [0.0, 17500.0] and best[0].typical_speed_kt == [0.0, 1320.0] and best[0].aircraft_variant == "MiG-29"
    chosen = hypotheses.select_offline(obs, hypotheses.hypotheses(rows, obs, 5), 2)
    assert [r.hypothesis for r in chosen.orderBy("rank").collect()][0] == "MiG-29"
    f = hypotheses.to_feature_rows(obs, chosen).orderBy("hypothesis").first()
    assert f.mean_source_reliability == 0.75 and f.kinematic_match_score == 0.5


def test_gate_on_the_row(spark):
    """Where the platform has no country, the variant's counts."""
    obs, nodes, edges = hypothesis_graph(spark)
    rows = hypotheses.graph_rows(obs, nodes, edges.filter("type <> 'LOCATED_IN'"), ["USES_RADAR"])
    got = {(r.hypothesis, r.aircraft_variant): r.operator_nation for r in rows.collect()}
    assert got == {("MiG-29", "MiG-29"): "Unknown", ("MiG-29", "MiG-29 (Romanian)"): "Russia", ("Su-27", "Su-27"): "Unknown"}


def test_offline_ranking(spark):
    obs = spark.createDataFrame([("o", "Slot Back [N-010 Zhuk-M]", "F", None, None)], "observation_id string, emission_sensor_name string, emission_target_type string, emission_speed double, emission_altitude double")
    rows = [("o", 1, "A", "India", ["10"], 50), ("o", 2, "B", "India", ["Zhuk"], 7), ("o", 3, "B", "India", ["Zhuk"], 3), ("o", 4, "B", "China", ["Zhuk"], 7), ("o", 5, " ", "x", ["Zhuk"], 99)]
    df = spark.createDataFrame(rows, "observation_id string, nth int, hypothesis string, operator_nation string, emitter_aliases array<string>, kg_support_count long").selectExpr("*", "cast(null as string) aircraft_variant", "'e' as emitter_variant", "'G' as platform_class", "array(0D, double('NaN')) typical_speed_kt", "array(0D, cast(null as double)) typical_altitude_m")
    got = hypotheses.select_offline(obs, df, 3).orderBy("rank").collect()
    assert [(r.hypothesis, r.operator_nation, r.nth) for r in got] == [("B", "India", 2), ("B", "China", 4), ("A", "India", 1)]


def test_unknown_range_bound(spark):
    r = spark.range(1).select(hypotheses.in_range(F.lit(5.0), F.array(F.lit(0.0), F.lit(float("nan")))), hypotheses.in_range(F.lit(5.0), F.array(F.lit(0.0), F.lit(9.0))), hypotheses.in_range(F.lit(None).cast("double"), F.array(F.lit(0.0), F.lit(9.0)))).first()
    assert list(r) == [0, 1, 0]


def test_fewer_than_asked(spark):
    """The best 4n rows are fetched before the check, so valid rows below are not seen."""
    keys = ["hypothesis string", "operator_nation string", "aircraft_variant string", "emitter_variant string"]
    rows = [("o", f"bad{i}", "India", "v", "e", ["Country"], 9.0) for i in range(4)] + [("o", "good", "India", "v", "e", ["Platform"], 1.0)]
    df = spark.createDataFrame(rows, f"observation_id string, {', '.join(keys)}, platform_labels array<string>, semantic_match_score double")
    extra = [f"cast(array() as array<string>) {c}" for c in ("aircraft_variant_labels", "operator_labels", "operator_country_labels", "matched_aliases", "max_speed_kt_values", "typical_speed_kt_values", "cruise_speed_kt_values", "service_ceiling_m_values", "max_altitude_m_values", "typical_altitude_m_values")]
    df = df.selectExpr("*", "1L support_count", "cast(array() as array<array<string>>) evidence_paths", *extra)
    obs = spark.createDataFrame([("o",)], "observation_id string")
    assert hypotheses.hypotheses(df, obs, 1).count() == 0
    assert [r.hypothesis for r in hypotheses.hypotheses(df, obs, 2).collect()] == ["good"]


def test_links_and_probes(spark):
    n, e = graph_of(spark, [("a", "X", "N", {}), ("b", "Y", "n", {}), ("c", "Y", "m", {})], [("a", "T", "c", None)])
    assert [(r.src, r.dst) for r in graph.link_by_name(n).collect()] == [("a", "b")]
    assert [(r.id, r.neighbour) for r in graph.probe_neighbours(n, e, n.filter("id = 'c'")).collect()] == [("c", "N")]


def test_shared_ids_are_an_error(spark):
    schema = "id string, labels array<string>, name string, aliases array<string>, props map<string,string>"
    sound = spark.createDataFrame([("a", ["Entity"], "A", [], {"k": "v"}), ("b", [], None, None, None), (None, [], "x", [], {})], schema)
    key = lambda r: str(r.id)
    assert sorted(graph.unique_nodes(sound).collect(), key=key) == sorted(sound.collect(), key=key)
    assert graph.unique_nodes(sound.limit(0)).count() == 0
    with pytest.raises(Exception, match="more than one node has the id b"):
        graph.unique_nodes(sound.union(sound.filter("id = 'b'"))).collect()
