import json
import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import geo
from tracewright.functions import probability as P
from tracewright.operators import calibration, candidates, evidential, explain

EXAMPLES = [
    ([2.6, 0.3, -0.4], 0),
    ([0.4, 1.7, 0.2], 1),
    ([0.1, 0.2, 1.1], 2),
    ([1.2, 0.8, 0.5], 1),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def poly(*points):
    return F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in points))


def test_distances(spark):
    d = lambda x: F.lit(float(x))
    square = poly((-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0))
    r = one(spark, geo.haversine_km(d(0), d(0), d(0), d(1)), geo.border_point(d(0), d(0), square)["d"], geo.border_point(d(0), d(0), poly((0.0, 1.0), (0.0, 1.0)))["d"], geo.border_point(d(0), d(0), poly((0.0, 1.0))))
    assert r[0] == pytest.approx(111.195080, abs=1e-6)
    assert r[1] == pytest.approx(111.18, abs=0.02)
    assert r[2] == pytest.approx(111.195080, abs=1e-6)
    assert r[3] is None


def test_distance_evidence(spark):
    rows = [("Belarus", 53.7, 28.0), (" united states", 53.7, 28.0), ("FRANCE", 46.2276, 2.2137), ("uk", 53.7, 28.0), ("x", None, 1.0)]
    df = spark.createDataFrame(rows, "nation string, la double, lo double")
    got = {r.nation: r for r in geo.with_distance(df, "nation", "la", "lo").collect()}
    assert got["Belarus"].distance_km == pytest.approx(137.435892, abs=1e-5)
    assert got["Belarus"].distance_score == pytest.approx(0.933590, abs=1e-6)
    assert got[" united states"].distance_km == pytest.approx(6077.524505, abs=1e-4)
    assert got["FRANCE"].distance_reference == "centroid" and got["FRANCE"].distance_km == pytest.approx(0, abs=1e-9)
    assert got["uk"].distance_km is None and got["x"].distance_adjustment is None


def test_polygons(spark):
    texts = ["[[1,2],[3,4]]", '[{"lat":1,"lng":2},{"latitude":3,"longitude":4},{"x":1}]', "[[1,2],[1]]", "nope", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(geo.parse_polygon(F.col("t"))).collect()]
    assert [[tuple(p) for p in x] if x else None for x in got] == [[(1, 2), (3, 4)], [(1, 2), (3, 4)], None, None, None]


def record(hypothesis, nation, **fields):
    return json.dumps({"scenario_id": "s", "contact_id": "c", "observation_time": "t", "hypothesis": hypothesis, "operator_nation": nation, **fields})


def groups(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line long, t string").select("line", F.parse_json("t").alias("record"))
    return candidates.probability_records(candidates.candidates_from_records(df), **options)


def test_two_candidates(spark):
    full = {"supporting_path_count": 3, "contradicting_path_count": 0, "emission_match_score": 1.0}
    r = groups(spark, [record("A", "India", **full), record("B", "India", supporting_path_count=1, contradicting_path_count=1)]).first()
    z = (3 * 0.65 + 1.1, 0.65 - 0.75)
    p = 1 / (1 + math.exp(z[1] - z[0]))
    assert r.top_platform == "A" and r.top_platform_probability == pytest.approx(p)
    assert [x["name"] for x in r.operator_nation_probabilities] == ["India"]


def test_marginal_beats_best_row(spark):
    r = groups(spark, [record("A", "Unknown", feature_logit=3.0), record("B", "India", feature_logit=2.9), record("B", "China", feature_logit=2.9)]).first()
    assert r.top_platform == "B" and r.candidates[0].platform == "A"
    assert r.top_operator_nation == "India"
    assert r.operator_nation_probabilities[0]["name"] == "Unknown"
    text = explain.explanation_payloads(groups(spark, [record("A", "Unknown", feature_logit=3.0), record("B", "India", feature_logit=2.9)])).first()
    assert "operator nation is India" in text.summary and len(text.confidence_limits) == 3
    assert text.llm_prompt.split("\n")[2].startswith('Platform distribution: {"A": 0.5')


def test_explicit_and_present_null_logits(spark):
    r = groups(spark, [record("A", "India", feature_logit=None, supporting_path_count=9), record("B", "India")]).first()
    assert [c.logit for c in r.candidates] == [0.0, 0.0]
    assert [c.platform for c in r.candidates] == ["A", "B"]


def test_unknown_only(spark):
    with pytest.raises(Exception, match="operator nation"):
        groups(spark, [record("A", "n/a")]).collect()
    assert groups(spark, [record("A", "n/a")], on_unknown="null").first().top_operator_nation is None


def test_row_polygon_and_nested_position(spark):
    r = groups(spark, [record("A", "Nowhere", feature_logit=1.0, features={"lattitude": 0.0, "longitude": 0.0}, operator_nation_border_coordinates=[[-1, -1], [-1, 1], [1, 1], [1, -1]], country_latitude=50, country_longitude=50)]).first()
    assert r.candidates[0].distance_km == pytest.approx(111.18, abs=0.02)
    assert r.candidates[0].logit == pytest.approx(1 + math.exp(-111.18 / 2000), abs=1e-4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "logits array<double>, label int")


def test_temperature(spark):
    over = [([6.0, 0.0], 0), ([6.0, 0.0], 0), ([6.0, 0.0], 1), ([0.0, 6.0], 1)]
    df = frame(spark, over)
    model = calibration.fit(df, ["a", "b"])

    def loss(t):
        return -sum(math.log(max(math.exp(x[y] / t) / sum(math.exp(v / t) for v in x), 1e-15)) for x, y in over) / len(over)

    t = model["temperature"]
    assert t > 1 and loss(t) < loss(1)
    assert all(loss(t) <= loss(t * k) + 1e-12 for k in (0.999, 1.001, 0.5, 2))
    before = calibration.report(df.withColumn("probabilities", P.softmax(F.col("logits")))).first()
    after = calibration.report(calibration.apply(df, model)).first()
    assert after.log_loss < before.log_loss and before.accuracy == after.accuracy == 0.75
    assert before.samples == 4 and before.reliability_bins[0]["count"] == 4


def test_report_by_hand(spark):
    df = spark.createDataFrame([([0.7, 0.3], 0), ([0.4, 0.6], 0), ([0.5, 0.5], 1)], "probabilities array<double>, label int")
    r = calibration.report(df).first()
    assert r.accuracy == pytest.approx(1 / 3)
    assert r.brier_score == pytest.approx((0.18 + 0.72 + 0.5) / 3)
    assert r.log_loss == pytest.approx(-(math.log(0.7) + math.log(0.4) + math.log(0.5)) / 3)
    assert r.expected_calibration_error == pytest.approx((0.3 + 0.6 + 0.5) / 3)
    with pytest.raises(Exception, match="invalid"):
        calibration.report(spark.createDataFrame([([0.7, 0.2], 0)], "probabilities array<double>, label int")).collect()


def test_bad_logits(spark):
    for rows in ([([1.0], 0)], [([1.0, 2.0], 2)], [([1.0, math.nan], 0)], [([1.0, 2.0], 0), ([1.0, 2.0, 3.0], 0)], []):
        with pytest.raises(ValueError):
            calibration.fit(frame(spark, rows))


def test_dirichlet(spark):
    df = spark.createDataFrame([([1.20, 1.15, 1.10], ["a", "b", "c"])], "alpha array<double>, labels array<string>")
    f = evidential.findings(df).first().finding
    assert f.probability == pytest.approx(0.347826, abs=1e-6) and f.belief_mass == pytest.approx(0.057971, abs=1e-6)
    assert f.ignorance_mass == pytest.approx(0.869565, abs=1e-6) and f.normalized_entropy == pytest.approx(0.999426, abs=1e-6)
    assert f.probability_margin == pytest.approx(0.014493, abs=1e-6) and f.confidence_band == "extreme uncertainty"
    text = evidential.narratives(evidential.findings(df)).first()
    assert text.narrative.startswith("Most likely emitter: a (hypothesis), probability 34.8%.") and len(text.recommended_collection) == 3
    with pytest.raises(Exception, match="alphas"):
        evidential.findings(df.withColumn("alpha", F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)))).collect()


def test_losses(spark):
    assert P.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert P.digamma(0.1) == pytest.approx(-10.423754940411076, abs=1e-8)
    assert evidential.kl_to_uniform([1.0, 1.0, 1.0]) == pytest.approx(0, abs=1e-12)
    assert evidential.loss([2.0, 1.0], 0, 0.0) == pytest.approx(P.digamma(3) - P.digamma(2))
    df = spark.createDataFrame([([2.0, 1.0], 0)], "alpha array<double>, target int")
    assert evidential.with_loss(df).first().loss == pytest.approx(0.5)


def test_convolution(spark):
    import numpy as np

    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [4.0, 4.0])], "id long, x array<double>")
    edges = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (3, 1, 1)], "src long, dst long, rel int")
    w = np.stack([np.eye(2), 2 * np.eye(2)])
    got = {r.id: r.x for r in evidential.convolve(nodes, edges, w, np.eye(2), np.array([0.0, -20.0])).collect()}
    assert got == {1: [1 + 2 + 8, 0.0], 2: [0.0, 0.0], 3: [4.0, 0.0]}
    out = evidential.infer(nodes, edges, [{"weights": w, "root": np.eye(2), "bias": np.zeros(2)}], {"weights": np.eye(2), "bias": np.zeros(2)}).collect()
    assert all(sum(r.belief) + r.ignorance == pytest.approx(1) for r in out)
    with pytest.raises(ValueError):
        evidential.validate_relations(edges.withColumn("rel", F.lit(9)))


def test_padded_features(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, None), ("a", 3, 9.0), ("b", 1, 4.0)], "k string, t int, x double")
    got = {r.k: (r.rows, r.n) for r in candidates.padded_features(df, ["k"], [F.col("t")], ["x", "t"], top=2).collect()}
    assert got == {"a": ([[0.0, 1.0], [1.0, 2.0]], 2), "b": ([[4.0, 1.0], [0.0, 0.0]], 1)}
