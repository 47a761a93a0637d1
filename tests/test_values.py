import math

from pyspark.sql import functions as F

from tracewright.functions import names as N
from tracewright.functions import values as V
from tracewright.functions.fixed import default_countries


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(spark, texts, *columns):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(*columns).collect()


def test_ids(spark):
    r = one(spark, V.stable_id("entity", "mig-29"), V.stable_id("a", F.lit(None).cast("string")), V.stable_id("a", ""))
    assert list(r) == ["95217cb739ecc912", "69fc94c033d1f48c", "69fc94c033d1f48c"]
    r = one(spark, V.evidence_query_id(F.lit("raid-001"), F.lit("C-101"), F.lit("2026-06-15T10:00:00Z"), F.lit("hostile_fighter")))
    assert r[0] == "fac81477b566ecd0"


def test_lenient_doubles(spark):
    texts = ["1.5", " 2 ", "1_000", "1__0", "1.5d", "", None, "nan", "-Infinity", "1e3", ".5", "5.", "0x10", "+7"]
    got = [r[0] for r in rows(spark, texts, V.optional_double(F.col("t")))]
    want = [1.5, 2.0, 1000.0, None, None, None, None, math.nan, -math.inf, 1000.0, 0.5, 5.0, None, 7.0]
    assert all(a == b or a is not None and b is not None and math.isnan(a) and math.isnan(b) for a, b in zip(got, want, strict=True))
    assert [r[0] for r in rows(spark, ["nan", "inf", "2"], V.finite_double(F.col("t")))] == [None, None, 2.0]
    assert [r[0] for r in rows(spark, ["nan", "inf", "2", "-1", "0.5", None], V.bounded(V.optional_double(F.col("t"))))] == [0, 0, 1, 0, 0.5, 0]
    assert [r[0] for r in rows(spark, ["nan", "-2", "3", None], V.non_negative(V.optional_double(F.col("t"))))] == [0, 0, 3, 0]


def test_coercion(spark):
    got = rows(spark, ["TRUE", "-07", "1.50", "2e3", "nil", " x ", "12345678901234567890"], F.to_json(V.coerced(F.col("t"))), V.python_text(F.col("t")))
    assert [r[1] for r in got] == ["True", "-7", "1.5", "2000.0", "nil", "x", "12345678901234567890"]
    assert got[0][0] == "true" and got[1][0] == "-7" and got[4][0] == '"nil"'
    assert [r[0] for r in rows(spark, [None, " ", " a "], V.clean_text(F.col("t")))] == ["unknown", "unknown", "a"]


def test_variants(spark):
    r = rows(spark, ['{"lat":"x","features":{"lattitude":"3.5"},"a":true,"n":"","m":0}'], *[V.first_number(F.parse_json("t"), "lat", "lattitude"), V.variant_number(F.parse_json("t"), "$.a"), V.first_text(F.parse_json("t"), "n", "m"), V.first_text(F.parse_json("t"), "zz", default="d")])[0]
    assert list(r) == [3.5, 1.0, "0", "d"]


def test_aliases(spark):
    r = rows(spark, ["Slot Back [N-010 Zhuk-M]"], N.emitter_aliases(F.col("t")), N.semantic_tokens(N.emitter_aliases(F.col("t"))), N.match_terms(N.emitter_aliases(F.col("t"))))[0]
    assert r[0] == ["Slot Back [N-010 Zhuk-M]", "N-010 Zhuk-M", "Slot Back", "N010 Zhuk M", "N010 Zhuk", "Zhuk M", "Slot Back N010 Zhuk M", "Slot Back N010 Zhuk"]
    assert r[1] == ["slot", "back", "n010", "zhuk"]
    assert r[2][0] == "slot back n 010 zhuk m"
    assert rows(spark, ["", None], N.emitter_aliases(F.col("t")))[0][0] == []


def test_canonical_names(spark):
    texts = ["Mikoyen MiG-29", "Mikoyan  mig 29SMT", "N019 radar", "Lockheed Martin F-16C", "Eurofighter Typhoon FGR.4", None]
    assert [r[0] for r in rows(spark, texts, N.canonical_name(F.col("t")))] == ["MiG-29", "MiG-29SMT", "N019 radar", "F-16C", "Typhoon-FGR.4", ""]


def test_nations(spark):
    terms = N.nation_terms(default_countries())
    texts = ["Indian Air Force Su-30", "MiG-29 of south korean", "Republic of Korea F-16", "Custom", "US", "bus", None, "Türkiye"]
    got = [r[0] for r in rows(spark, texts, N.nation_in_text(F.col("t"), terms))]
    assert got == ["India", "South Korea", "South Korea", None, "United States", None, None, None]
    assert [r[0] for r in rows(spark, ["India", " n/a ", "NA", None, "x"], N.is_unknown_nation(F.col("t")))] == [False, True, True, True, False]
    v, n = N.variant_without_nation(F.col("t"), F.lit("MiG-29"), terms)
    assert [tuple(r) for r in rows(spark, ["MiG-29 (Romanian)", "MiG-29SMT", ""], v, n)] == [("MiG-29", "Romania"), ("MiG-29SMT", None), ("MiG-29", None)]


def test_numbers_in_text(spark):
    got = rows(spark, ["Mach 2.25 (1,320 kt)", "57,400 ft (17,500 m)", "about 900", "none", None], N.number_in_text(F.col("t"), ["kt", "kts", "m"]))
    assert [r[0] for r in got] == [1320.0, 17500.0, 900.0, None, None]
    bound = N.upper_bound([F.array(F.lit("0 kt")), F.array(F.lit("x"), F.lit("700 kts"))], ["kt", "kts"])
    assert one(spark, bound)[0] == 700.0


def test_candidate_labels(spark):
    a = lambda *x: F.array(*(F.lit(i) for i in x)) if x else F.array().cast("array<string>")
    ok = N.valid_candidate
    r = one(
        spark,
        ok(a("Entity", "Platform"), a(), F.lit("India"), a("Operator"), a("Country")),
        ok(a("Country"), a(), F.lit("India"), a(), a()),
        ok(a("Entity"), a(), F.lit(""), a(), a()),
        ok(a("Platform"), a("Aircraft"), F.lit("India"), a(), a("Location")),
        ok(a("Platform"), a(), F.lit("n/a"), a("Sensor"), a("Location")),
        ok(a(), a(), F.lit("India"), a("Sensor"), a()),
    )
    assert list(r) == [True, False, False, False, True, False]


def test_whitelist():
    import pytest

    assert N.relationship_types([" uses_radar", "USES_RADAR", "FACT"]) == ["USES_RADAR", "FACT"]
    with pytest.raises(ValueError):
        N.relationship_types(["FACT]-(x) DETACH"])


def test_path_ids(spark):
    r = one(spark, N.evidence_path_id(F.expr("array(array('HAS_SENSOR'), array(), array('DETECTED_BY','OPERATED_BY'))")), N.evidence_path_id(F.expr("cast(null as array<array<string>>)")))
    assert list(r) == ["HAS_SENSOR|DETECTED_BY>OPERATED_BY", ""]
