"""More of the engine's operators as queries: names, nations, graphs, hypotheses, explanations, the evidential head."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fixed, geo, names
from tracewright.operators import candidates as cand
from tracewright.operators import dataset, evidential, explain, facts, graph, hypotheses, observations
from tracewright.plans.inputs import fk_graph, log_lines, table
from tracewright.plans.queries import EXAMPLES_SQL, _examples, _places, query, r6
from tracewright.sources import logs


def _id(*parts: str) -> str:
    """SQL for the id of a node: the parts are SQL texts."""
    return f"substr(sha256(array_to_string([{', '.join(parts)}], chr(31))), 1, 16)"


def _cases(key: Column, *texts: Column | str) -> Column:
    """The text whose place is key modulo their number."""
    as_column = [t if isinstance(t, Column) else F.lit(t) for t in texts]
    out = as_column[-1]
    for i, t in enumerate(as_column[:-1]):
        out = F.when(key % len(texts) == i, t).otherwise(out)
    return out


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MiG-' || p_size WHEN 1 THEN 'Su-' || p_size WHEN 2 THEN 'N019 radar' ELSE p_name END AS name FROM part
""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = _cases(k, F.concat(F.lit("Mikoyan MiG-"), size), F.concat(F.lit("SUKHOI  su "), size), "  N019   radar ", F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", names.canonical_name(raw).alias("name"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'Kfir C' || p_size ELSE p_name END AS variant,
       CASE p_partkey % 5 WHEN 0 THEN 'United States' WHEN 3 THEN 'India' WHEN 4 THEN 'New Zealand' END AS nation FROM part
""")
def variant_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    variant = _cases(k, "F-16 American export", F.concat(F.lit(" Kfir C"), F.col("p_size")), " ", "sold to INDIA (air force)", "A-4K/New  Zealand")
    v, nation = names.variant_without_nation(variant, F.col("p_name"), names.nation_terms(fixed.default_countries()))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("variant"), nation.alias("nation"))


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1, 2) AS known, c_custkey % 6 = 5 AS unknown FROM customer")
def country_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _cases(F.col("c_custkey"), "fiji", "  new   zealand ", "Côte d'Ivoire", "Atlantis", F.col("c_name"), " N/A ")
    return table(spark, sf_dir, "customer").select("c_custkey", names.is_country(name, fixed.default_countries()).alias("known"), names.is_unknown_nation(name).alias("unknown"))


@query("""
WITH x AS (
  SELECT c_custkey, ((c_custkey * 37) % 160 - 80)::DOUBLE AS lat, ((c_custkey * 53) % 340 - 170)::DOUBLE AS lon,
         CASE c_custkey % 3 WHEN 0 THEN 46.2276 WHEN 1 THEN 0.0 END::DOUBLE AS a, CASE c_custkey % 3 WHEN 0 THEN 2.2137 WHEN 1 THEN 0.0 END::DOUBLE AS b FROM customer
), d AS (SELECT c_custkey, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(a) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * pow(sin((radians(b) - radians(lon)) / 2), 2))) AS km FROM x)
SELECT c_custkey, round(km, 4) AS km, CASE WHEN km IS NOT NULL THEN 'centroid' END AS reference, round(exp(-km / 2000), 6) AS adjustment FROM d
""")
def centre_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """France by its centre, Fiji, which has none, by (0, 0), and a nation that is no country."""
    rows = _places(spark, sf_dir).withColumn("nation", _cases(F.col("c_custkey"), " FRANCE", "Fiji", "Atlantis"))
    out = geo.with_distance(rows, "nation", "lat", "lon")
    return out.select("c_custkey", F.round("distance_km", 4).alias("km"), F.col("distance_reference").alias("reference"), r6(F.col("distance_adjustment"), "adjustment"))


@query(f"""
WITH {EXAMPLES_SQL}, n AS (SELECT count(*) AS n FROM x WHERE label <> 'unknown')
SELECT 'train' AS split, floor(n * 0.7)::BIGINT AS n FROM n UNION ALL SELECT 'val', floor(n * 0.15)::BIGINT FROM n UNION ALL SELECT 'test', (n - floor(n * 0.7) - floor(n * 0.15))::BIGINT FROM n
""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = dataset.drop_unknown(_examples(spark, sf_dir)).select("id")
    return dataset.split_sizes(dataset.split_by_hash(examples, "id", 0.7, 0.15, 1))


@query("""
SELECT s_suppkey AS source_line, substr(sha1('f:' || s_suppkey || ':{"a": "' || s_name || '", "b": [1, 2.5]}'), 1, 16) AS id, s_name AS name FROM supplier
""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of records without a guid: of file, line and record."""
    text = F.concat(F.lit('{"b":[1,2.5] , "a":"'), F.col("s_name"), F.lit('"}'))
    rows = table(spark, sf_dir, "supplier").select(F.lit("f").alias("path"), F.col("s_suppkey").alias("line"), text.alias("text"), F.col("s_name").alias("n"))
    out = dataset.build_examples(rows.select("path", "line", "text", F.parse_json("text").alias("record")))
    return out.join(rows.select(F.col("line").alias("source_line"), "n"), "source_line").select("source_line", "id", F.col("n").alias("name"))


@query("SELECT min(event_id) AS line, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal records of a log, whatever the order of their keys: the first stays."""
    e = table(spark, sf_dir, "events")
    pair = [F.concat(F.lit('"u":'), F.col("user_id")), F.concat(F.lit('"t":"'), F.col("event_type"), F.lit('"'))]
    text = F.concat(F.lit('x {"source":"cmo_lua",'), F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", *pair)).otherwise(F.concat_ws(" , ", *reversed(pair))), F.lit("} y"))
    r = logs.recover_records(e.select(F.col("event_id").alias("line"), text.alias("text")), unique=True)
    return r.select("line", F.try_variant_get("record", "$.u", "long").alias("user_id"), F.try_variant_get("record", "$.t", "string").alias("event_type"))


def _graph_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as observations, their orders as graph rows: every second platform is a country, and so no platform."""
    empty = F.array().cast("array<string>")
    o = table(spark, sf_dir, "orders")
    lists = {f"{p.lower()}_values": empty for p in fixed.SPEED_FACTS + fixed.ALTITUDE_FACTS}
    lists["typical_speed_kt_values"] = F.array(F.lit("unknown"), F.concat(F.lit("Mach 2 ("), F.col("o_orderkey") % 1000, F.lit(" kt)")))
    lists["service_ceiling_m_values"] = F.array(F.concat(F.lit("57,400 ft ("), F.format_number(F.col("o_orderkey"), 0), F.lit(" m)")))
    rows = o.select(
        F.col("o_custkey").alias("observation_id"), F.concat(F.lit(" P"), F.col("o_orderkey")).alias("hypothesis"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderpriority")).alias("operator_nation"),
        F.when(F.col("o_orderkey") % 5 == 0, "export, Fiji").otherwise(F.concat(F.lit("V"), F.col("o_orderkey"))).alias("aircraft_variant"), F.lit("e").alias("emitter_variant"), F.array(F.lit("e")).alias("matched_aliases"),
        (F.col("o_orderkey") % 7).alias("support_count"), F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.col("o_orderpriority"))).alias("evidence_paths"),
        F.array(F.when(F.floor(F.col("o_orderkey") / 2) % 2 == 0, "Country").otherwise("Platform")).alias("platform_labels"), empty.alias("aircraft_variant_labels"), empty.alias("operator_labels"), empty.alias("operator_country_labels"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias("semantic_match_score"), *(c.alias(n) for n, c in lists.items()),
    )
    obs = o.select(F.col("o_custkey").alias("observation_id")).distinct().withColumn("emission_sensor_name", F.when(F.col("observation_id") % 2 == 0, "radar E 1").otherwise("x"))
    return obs.withColumn("emission_speed", F.lit(500.0)).withColumn("emission_altitude", F.lit(9000.0)), rows


CHECKED_SQL = """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 100000) DESC, o_orderkey % 7 DESC, ' P' || o_orderkey) AS k FROM orders
), v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS nth FROM r WHERE k <= 8 AND (o_orderkey // 2) % 2 <> 0),
h AS (
  SELECT o_custkey AS observation_id, CAST(nth AS INTEGER) AS nth, 'P' || o_orderkey AS hypothesis, o_orderkey, o_orderpriority,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'Fiji' ELSE 'n/a' END AS operator_nation,
         CASE WHEN o_orderkey % 5 = 0 THEN 'P' || o_orderkey ELSE 'V' || o_orderkey END AS aircraft_variant,
         CASE WHEN o_orderkey % 1000 > 0 THEN (o_orderkey % 1000)::DOUBLE END AS top_speed, o_orderkey::DOUBLE AS top_altitude, o_orderkey % 7 AS support
  FROM v WHERE nth <= 2
)
"""


@query(CHECKED_SQL + "SELECT observation_id, nth, hypothesis, operator_nation, aircraft_variant, top_speed, top_altitude FROM h")
def checked_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight rows are fetched, checked, and cut to two; ranges come from texts."""
    obs, rows = _graph_rows(spark, sf_dir)
    out = hypotheses.hypotheses(rows, obs, 2)
    return out.select("observation_id", "nth", "hypothesis", "operator_nation", "aircraft_variant", F.col("typical_speed_kt")[1].alias("top_speed"), F.col("typical_altitude_m")[1].alias("top_altitude"))


@query(CHECKED_SQL + """
SELECT observation_id, hypothesis, support::DOUBLE AS supporting_path_count, CASE WHEN observation_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS emission_match_score,
       (CASE WHEN top_speed >= 500 THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN top_altitude >= 9000 THEN 0.5::DOUBLE ELSE 0.0 END) AS kinematic_match_score, 'A>B|' || o_orderpriority AS evidence_query_id FROM h
""")
def hypothesis_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, rows = _graph_rows(spark, sf_dir)
    out = hypotheses.to_feature_rows(obs, hypotheses.hypotheses(rows, obs, 2))
    return out.select("observation_id", "hypothesis", "supporting_path_count", "emission_match_score", "kinematic_match_score", "evidence_query_id")


@query("""
WITH x AS (
  SELECT o_orderkey AS idx, o_orderkey % 4 AS k, 'p' || o_orderkey AS platform, CASE WHEN o_orderkey % 3 = 0 THEN 'Fiji' ELSE 'unknown' END AS operator_nation,
         CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 + 1.5 WHEN 1 THEN 0 WHEN 2 THEN 0.65 * (o_orderkey % 9) ELSE 1.1 END::DOUBLE AS base, (o_orderkey % 60)::DOUBLE AS lat FROM orders
)
SELECT idx, platform, operator_nation, round(base, 6) AS base_logit, round(base + CASE WHEN operator_nation = 'Fiji' AND k <> 3 THEN exp(-radians(lat) * 6371.0088 / 2000) ELSE 0 END, 6) AS logit FROM x
""")
def record_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows of JSON records: old field names, explicit, bad and linear logits, positions beside or nested."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    logit = _cases(k, F.concat(F.lit('"feature_logit":"'), k % 7 + 1.5, F.lit('",')), '"feature_logit":"x",', F.concat(F.lit('"supporting_path_count":"'), k % 9, F.lit('",')), '"emission_match_score":true,')
    at = _cases(k, F.concat(F.lit('"lattitude":'), k % 60, F.lit(',"lng":0')), F.concat(F.lit('"features":{"latitude":"'), k % 60, F.lit('","lon":0}')), F.concat(F.lit('"lat":'), k % 60, F.lit(',"longitude":"0"')), '"lat":null')
    text = F.concat(F.lit('{"hypothesis":"","platform_type":"p'), key, F.lit('",'), F.when(k % 3 == 0, '"nation":"Fiji",').otherwise('"nation":"",'), logit, at, F.lit("}"))
    out = cand.candidates_from_records(table(spark, sf_dir, "orders").select(k.alias("line"), F.parse_json(text).alias("record")))
    return out.select("idx", "platform", "operator_nation", r6(F.col("base_logit"), "base_logit"), r6(F.col("logit"), "logit"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k FROM lineitem)
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, 4::BIGINT AS size, round(sum(l_quantity * k), 4) AS weighted FROM r WHERE k <= 4 GROUP BY l_orderkey
""")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), *(F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))]
    out = cand.padded_features(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, ["l_quantity"], top=4)
    weighted = F.aggregate(F.transform("rows", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("l_orderkey", F.col("n").cast("int").alias("n"), F.size("rows").cast("long").alias("size"), F.round(weighted, 4).alias("weighted"))


@query("""
WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT r_regionkey, string_agg('  ' || k || '. ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (' || r_name || ')' ELSE '' END, chr(10) ORDER BY k) AS lines, '  none supplied' AS without FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey
""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.struct("n_nationkey", F.col("n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("source"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source")))
    return rows.groupBy("r_regionkey").agg(items.alias("items")).select("r_regionkey", explain.evidence_lines(F.col("items"), "none supplied").alias("lines"), explain.evidence_lines(F.lit(None).cast(explain.EVIDENCE), "none supplied").alias("without"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'fallback' ELSE upper(s_name) END AS explanation FROM supplier")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completer's texts; where it gives none, the fallback."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("prompt"), F.lit("fallback").alias("plain"))
    return explain.complete(rows, "prompt", "plain", _upper).select("s_suppkey", "explanation")


def _upper(prompts: list[str]) -> list[str | None]:
    return [p.upper() or None for p in prompts]


@query("""
WITH e AS (SELECT vec_id, [x::DOUBLE * 10 for x in embedding] AS z FROM embeddings),
a AS (SELECT vec_id, [greatest(x, 0) + ln(1 + exp(-abs(x))) + 1 for x in z] AS alpha FROM e), s AS (SELECT vec_id, len(alpha) AS k, alpha, list_sum(alpha) AS s FROM a),
o AS (SELECT vec_id, k, s, list_sort([x / s for x in alpha], 'DESC') AS p, list_sum([-(x / s) * ln(greatest(x / s, 1e-12)) for x in alpha]) / ln(k) AS entropy FROM s),
m AS (SELECT vec_id, least(1, k / s) >= 0.6 OR entropy >= 0.9 OR p[1] - p[2] <= 0.05 AS extreme FROM o)
SELECT vec_id, extreme, CAST(CASE WHEN extreme THEN 4 ELSE 1 END AS BIGINT) AS actions, extreme AS says_so FROM m
""")
def evidential_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of whole vectors as logits, with one action of their own that is named twice."""
    z = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    found = evidential.findings(evidential.forward(z).withColumn("labels", F.transform("logits", lambda x, i: F.concat(F.lit("e"), i.cast("string")))))
    out = evidential.narratives(found.withColumn("missing_evidence", F.array(F.lit("ask"), F.lit("ask"))))
    return out.select("vec_id", F.col("finding.extreme_uncertainty").alias("extreme"), F.size("recommended_collection").cast("long").alias("actions"), F.col("narrative").contains("unreliable").alias("says_so"))


@query("""
WITH x AS (SELECT o_orderkey, [2 + o_orderkey % 4, 2 + o_custkey % 3, 2]::BIGINT[] AS a, o_orderkey % 3 AS t FROM orders),
y AS (SELECT o_orderkey, a, t, [CASE WHEN i - 1 = t THEN 1 ELSE a[i] END for i in [1, 2, 3]]::BIGINT[] AS r FROM x),
h AS (SELECT k, coalesce((SELECT sum(1.0::DOUBLE / i) FROM generate_series(1, k - 1) g(i)), 0) AS psi FROM generate_series(1, 40) s(k)),
u AS (SELECT o_orderkey, a, t, r, unnest([1, 2, 3]) AS i FROM y),
k AS (
  SELECT o_orderkey, sum((a[i] - 1) * (h.psi - g.psi)) + lgamma(list_sum(any_value(a))::DOUBLE) - sum(lgamma(a[i]::DOUBLE)) - lgamma(3.0::DOUBLE) AS kl FROM u JOIN h ON h.k = a[i] JOIN h g ON g.k = list_sum(a) GROUP BY o_orderkey
), l AS (
  SELECT o_orderkey, sum((r[i] - 1) * (h.psi - g.psi)) + lgamma(list_sum(any_value(r))::DOUBLE) - sum(lgamma(r[i]::DOUBLE)) - lgamma(3.0::DOUBLE) AS kl FROM u JOIN h ON h.k = r[i] JOIN h g ON g.k = list_sum(r) GROUP BY o_orderkey
)
SELECT o_orderkey, round(k.kl, 6) AS kl, round(s.psi - p.psi + 0.1 * l.kl, 6) AS loss FROM y JOIN k USING (o_orderkey) JOIN l USING (o_orderkey) JOIN h s ON s.k = list_sum(a) JOIN h p ON p.k = a[t + 1]
""")
def evidential_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alphas, for which digamma is a sum of fractions."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array((k % 4 + 2).cast("double"), (F.col("o_custkey") % 3 + 2).cast("double"), F.lit(2.0)).alias("alpha"), (k % 3).cast("int").alias("target"))
    return evidential.with_loss(rows).select("o_orderkey", r6(F.col("kl"), "kl"), r6(F.col("loss"), "loss"))


@query("""
WITH x AS (SELECT 's' || s_suppkey AS id, 1.0::DOUBLE AS a, s_nationkey::DOUBLE AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey FROM nation),
e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 0 AS rel FROM supplier UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 1 FROM supplier),
m AS (SELECT dst, rel, avg(a) AS a, avg(b) AS b FROM e JOIN x ON src = id GROUP BY ALL),
s AS (SELECT dst, sum(CASE rel WHEN 0 THEN a - b ELSE 2 * b END) AS u, sum(CASE rel WHEN 0 THEN 0.5 * b ELSE a - 0.25 * b END) AS v FROM m GROUP BY dst)
SELECT id, round(greatest(0, a + 0.5 * b + coalesce(u, 0) + 0.25), 6) AS u, round(greatest(0, b - a + coalesce(v, 0) - 0.5), 6) AS v FROM x LEFT JOIN s ON dst = id
""")
def relational_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    ident = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    x = lambda c: F.array(F.lit(1.0), F.col(c).cast("double")).alias("x")
    nodes = s.select(ident("s", "s_suppkey").alias("id"), x("s_nationkey")).unionByName(n.select(ident("n", "n_nationkey").alias("id"), x("n_regionkey")))
    a, b = ident("s", "s_suppkey"), ident("n", "s_nationkey")
    edges = s.select(a.alias("src"), b.alias("dst"), F.lit(0).alias("rel")).unionByName(s.select(b.alias("src"), a.alias("dst"), F.lit(1).alias("rel")))
    evidential.validate_relations(edges)
    weights = np.array([[[1.0, 0.0], [-1.0, 0.5]], [[0.0, 1.0], [2.0, -0.25]]])
    out = evidential.convolve(nodes, edges, weights, np.array([[1.0, -1.0], [0.5, 1.0]]), np.array([0.25, -0.5]))
    return out.select("id", r6(F.col("x")[0], "u"), r6(F.col("x")[1], "v"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers have their nations as sensors; sources are the nations' keys."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.col("s_suppkey").alias("seq"), F.col("s_name").alias("subject"), F.lit("HAS_SENSOR").alias("predicate"), F.col("n_name").alias("object"), F.concat(F.lit("src"), F.col("s_nationkey")).alias("source_id"),
        F.lit("web").alias("source_type"), F.concat(F.lit("l"), F.col("s_suppkey")).alias("locator"), F.lit("because").alias("evidence"), (F.col("s_suppkey") % 4 / 4).alias("confidence"),
    )


@query(f"""
SELECT DISTINCT {_id("'entity'", "lower(s_name)")} AS id, 'Entity,Platform,ReferenceEntity' AS labels, s_name AS name, NULL AS locator FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
SELECT DISTINCT {_id("'entity'", "lower(n_name)")}, 'Entity,ReferenceEntity,Sensor', n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
SELECT 'src' || s_nationkey, 'Source', NULL, 'l' || max(s_suppkey) FROM supplier GROUP BY s_nationkey
""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that facts give: entities with the labels of their roles, sources with what the last fact says."""
    nodes, _ = graph.fact_graph(_facts(spark, sf_dir))
    return nodes.select("id", F.array_join("labels", ",").alias("labels"), "name", F.col("props")["locator"].alias("locator"))


@query(f"""
WITH f AS (SELECT s_suppkey, s_nationkey, {_id("'entity'", "lower(s_name)")} AS s, {_id("'entity'", "lower(n_name)")} AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s AS src, o AS dst, 'FACT' AS type, 'HAS_SENSOR' AS predicate, 'src' || s_nationkey AS source, (s_suppkey % 4 / 4)::DOUBLE AS confidence FROM f UNION ALL
SELECT s, o, 'HAS_SENSOR', NULL, 'src' || max(s_nationkey), max_by(s_suppkey % 4 / 4, s_suppkey)::DOUBLE FROM f GROUP BY s, o UNION ALL
SELECT DISTINCT s, 'src' || s_nationkey, 'MENTIONED_IN', NULL, NULL, NULL FROM f UNION ALL SELECT DISTINCT o, 'src' || s_nationkey, 'MENTIONED_IN', NULL, NULL, NULL FROM f
""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that facts give: each fact, one typed edge for a pair of ends, and where the ends are mentioned."""
    _, edges = graph.fact_graph(_facts(spark, sf_dir))
    return edges.select("src", "dst", "type", "predicate", F.col("props")["source_id"].alias("source"), F.col("props")["confidence"].cast("double").alias("confidence"))


OBSERVED_SQL = f"""
WITH e AS (SELECT event_id, user_id, event_type, event_id + 1 AS line, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 50 END AS age FROM events WHERE event_id % 7 <> 0),
o AS (SELECT *, 'U-' || user_id AS platform, '[S.' || event_type || ']' AS sensor, 'Type: ' || event_type AS class,
  {_id("'cmo-observation'", "event_id::VARCHAR", "'U-' || user_id", "'[S.' || event_type || ']'", "''", "''", "line::VARCHAR")} AS id FROM e),
i AS (SELECT *, {_id("'contact'", "id")} AS contact_id, {_id("'platform'", "lower(platform)")} AS platform_id, {_id("'sensor'", "lower(sensor)")} AS sensor_id FROM o)
"""


@query(OBSERVED_SQL + """
SELECT 'Observation' AS label, id, NULL AS name, line::VARCHAR AS line FROM i UNION ALL SELECT DISTINCT 'Platform', platform_id, platform, NULL FROM i UNION ALL SELECT DISTINCT 'Sensor', sensor_id, sensor, NULL FROM i
""")
def observation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = observations.observation_graph(observations.parse_observations(log_lines(spark, sf_dir).select("line", "text")))
    own = nodes.select(F.col("labels")[0].alias("label"), "id", "name", F.col("props")["source_line"].alias("line"))
    return own.filter(F.col("label").isin("Observation", "Platform", "Sensor"))


@query(OBSERVED_SQL + "SELECT id AS src, platform_id AS dst, 'OBSERVED_BY' AS type FROM i UNION ALL SELECT DISTINCT platform_id, sensor_id, 'DETECTS' FROM i")
def observation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = observations.observation_graph(observations.parse_observations(log_lines(spark, sf_dir).select("line", "text")))
    return edges.filter(F.col("type").isin("OBSERVED_BY", "DETECTS")).select("src", "dst", "type")


@query("""
WITH e AS (
  SELECT 'r' || n_regionkey AS id, 'LOCATED_IN' AS type, n_name AS neighbour FROM nation UNION ALL SELECT 'n' || n_nationkey, 'LOCATED_IN', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'n' || s_nationkey, 'OPERATOR_COUNTRY', s_name FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'HOME_BASE_COUNTRY', c_name FROM customer
)
SELECT * FROM e WHERE id IN ('r1', 'n3', 'n4') ORDER BY id, type, neighbour LIMIT 50
""")
def probe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = fk_graph(spark, sf_dir)
    return graph.probe_neighbours(nodes, edges, spark.createDataFrame([("r1",), ("n3",), ("n4",)], "id string"))


@query("""
SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Platform,Entity,Seen' ELSE 'Platform,Entity' END AS labels, CASE WHEN s_suppkey % 4 = 0 THEN 'renamed' ELSE s_name END AS name FROM supplier UNION ALL
SELECT 'r' || r_regionkey, 'Location,Entity', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Country,Entity', n_name FROM nation
""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second graph over a first: labels are added, a name replaces one unless it is null, and ids stay unique."""
    nodes, edges = fk_graph(spark, sf_dir)
    listed = nodes.filter("not id like 'c%'").select("id", "labels", "name", F.array().cast("array<string>").alias("aliases"), "props")
    k = F.substring("id", 2, 20).cast("long")
    again = listed.filter(F.col("id").startswith("s") & (k % 2 == 0)).withColumn("labels", F.array(F.lit("Seen"))).withColumn("name", F.when(k % 4 == 0, "renamed"))
    merged, _ = graph.merge_graphs((listed, edges), (again, edges.limit(0)))
    return merged.join(graph.duplicate_ids(merged), "id", "left_anti").select("id", F.array_join("labels", ",").alias("labels"), "name")


@query("""
SELECT count(*) AS replies, sum(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS blank, sum(CASE WHEN s_suppkey % 4 IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS with_object,
       sum(CASE WHEN s_suppkey % 4 = 1 THEN 2 WHEN s_suppkey % 4 = 2 THEN 1 ELSE 0 END)::BIGINT AS items, sum(CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS facts, sum(CASE WHEN s_suppkey % 4 IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS left_out
FROM supplier
""")
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = _cases(F.col("s_suppkey"), "  ", '{"facts":[{"subject":"a","object":"b"},{"subject":"a"}]}', 'so: {"facts":[{"subject":" ","object":"b"}]}', "prose")
    return facts.extraction_counts(table(spark, sf_dir, "supplier").select("s_suppkey", reply.alias("reply")), ["s_suppkey"])


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, unnest(generate_series(0, greatest(length(t) - 200 - 1, 0), 1800)) AS s FROM d WHERE length(t) > 0)
SELECT doc_id::VARCHAR AS source_id, CAST(s // 1800 AS INTEGER) AS chunk_index, 'NEXT_TO' AS predicate, 'o' || (s // 1800) AS object, least(1, (s // 1800) / 4)::DOUBLE AS confidence FROM s WHERE (s // 1800) % 3 <> 2
""")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents joined with a table of completions, one of three of which is prose."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit("web").alias("source_type"), F.lit("l").alias("locator"), F.lit("t").alias("title"), "text")
    chunks = facts.explode_chunks(docs.select("source_id", "text"), 2000, 200)
    i = F.col("chunk_index")
    fact = F.concat(F.lit('```json\n{"facts":[{"subject":"s","predicate":"next to","object":"o'), i, F.lit('","confidence":'), i / 4, F.lit("}]}\n```"))
    out = facts.extract_facts(docs, chunks.select("source_id", "chunk_index", F.when(i % 3 == 2, "none here").otherwise(fact).alias("reply")), 2000, 200)
    return out.select("source_id", "chunk_index", "predicate", "object", "confidence")
