"""Domain inputs made of the TPC-H-like tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.probability import contradiction_ratio, linear_logit
from tracewright.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: What tells lines of one order apart, in order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def candidates(spark: SparkSession, sf_dir: str, unknown: bool = False) -> DataFrame:
    """Orders as contacts, their lines as candidates: platform = supplier, nation = the supplier's.

    With unknown, nations with a key divisible by 3 are called Unknown.
    """
    from pyspark.sql import Window

    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    support, contradict = F.col("l_linenumber").cast("double"), (F.col("l_returnflag") == "R").cast("double")
    features = {
        "supporting_path_count": support,
        "contradicting_path_count": contradict,
        "mean_source_reliability": F.col("l_quantity") / 50,
        "recency": 1.0 / (1.0 + F.col("l_discount") * 100),
        "shortest_path_to_platform_class": (F.col("l_partkey") % 4 + 1).cast("double"),
        "emission_match_score": F.col("l_discount") * 10,
        "kinematic_match_score": F.col("l_tax") * 10,
        "contradiction_score": contradiction_ratio(support, contradict),
    }
    nation = F.when(F.col("n_nationkey") % 3 == 0, "Unknown").otherwise(F.col("n_name")) if unknown else F.col("n_name")
    return lines.select(
        F.col("l_orderkey").alias("contact_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("idx"),
        F.col("l_suppkey").cast("string").alias("platform"),
        nation.alias("operator_nation"),
        linear_logit(features).alias("logit"),
    )


CANDIDATES_SQL = """
c AS (
  SELECT l_orderkey AS contact_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS idx,
         CAST(l_suppkey AS VARCHAR) AS platform, {nation} AS operator_nation,
         0.0::DOUBLE + 0.65::DOUBLE * l_linenumber + -0.75::DOUBLE * r + 0.8::DOUBLE * (l_quantity / 50) + 0.5::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + l_discount * 100))
         + -0.2::DOUBLE * (l_partkey % 4 + 1) + 1.1::DOUBLE * (l_discount * 10) + 0.9::DOUBLE * (l_tax * 10) + -1.2::DOUBLE * (r / (l_linenumber + r)) AS logit
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY contact_id)) AS e FROM c),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY contact_id) AS probability FROM p)
"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as classifications: the logits are ten times the first ten components, the truth is the label."""
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("logits"), F.col("label").cast("int").alias("label"))


LOGITS_SQL = """
z AS (SELECT vec_id, label, unnest([x::DOUBLE * 10 for x in embedding[1:10]]) AS z, unnest(generate_series(0, 9)) AS k FROM embeddings)
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line and text: events as key-value log lines, every seventh without the mark."""
    e = table(spark, sf_dir, "events")
    mark = F.when(F.col("event_id") % 7 == 0, "NOTE").otherwise("tick PY_CONTACT_LOG")
    pair = lambda k, v: F.concat(F.lit(f"{k} : "), v.cast("string"))
    text = F.concat(
        mark, F.lit(" "), F.concat_ws(
            ", ", pair("Time", F.col("event_id")), pair("Sensor_aircraft", F.concat(F.lit("U-"), F.col("user_id"))), pair("Emission_sensor_name", F.concat(F.lit("[S."), F.col("event_type"), F.lit("]"))),
            pair("Emission_age", F.when(F.col("event_id") % 5 == 0, F.lit("nil")).otherwise((F.col("user_id") % 50).cast("string"))), pair("Emission_solid", (F.col("user_id") % 2 == 0)),
            pair("Emission_target_type", F.concat(F.lit("Type: "), F.col("event_type"))),
        ),
    )
    return e.select((F.col("event_id") + 1).alias("line"), text.alias("text"), "event_id", "user_id", "event_type", "value", "props")


def fk_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and customers as nodes, foreign keys as edges."""
    t = lambda n: table(spark, sf_dir, n)
    ident = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.create_map().cast("map<string,string>")
    node = lambda df, kind, key, name, labels: df.select(ident(kind, key).alias("id"), F.array(*(F.lit(x) for x in labels)).alias("labels"), F.col(name).alias("name"), none.alias("props"))
    nodes = node(t("region"), "r", "r_regionkey", "r_name", ["Location", "Entity"]).unionByName(node(t("nation"), "n", "n_nationkey", "n_name", ["Country", "Entity"])).unionByName(node(t("supplier"), "s", "s_suppkey", "s_name", ["Platform", "Entity"])).unionByName(node(t("customer"), "c", "c_custkey", "c_name", ["Contact"]))
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(ident(a, ka), F.lit(">"), ident(b, kb)).alias("eid"), ident(a, ka).alias("src"), ident(b, kb).alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("predicate"), none.alias("props"))
    edges = edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "LOCATED_IN").unionByName(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "OPERATOR_COUNTRY")).unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey", "HOME_BASE_COUNTRY"))
    return nodes, edges


EDGES_SQL = """
edges AS (
  SELECT 'n' || n_nationkey || '>r' || n_regionkey AS eid, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'LOCATED_IN' AS type FROM nation UNION ALL
  SELECT 's' || s_suppkey || '>n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'OPERATOR_COUNTRY' FROM supplier UNION ALL
  SELECT 'c' || c_custkey || '>n' || c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, 'HOME_BASE_COUNTRY' FROM customer
)
"""


def contact_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests, nodes, edges: suppliers as contacts, with an observation each, their nations as classes and sources.

    Suppliers are classified as their nation; nations are in regions, and contradict the nation with the next key.
    """
    t = lambda n: table(spark, sf_dir, n)
    ident = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    labels = lambda *x: F.array(*(F.lit(i) for i in x)).alias("labels")
    none = F.create_map().cast("map<string,string>")
    no_name = F.lit(None).cast("string").alias("name")
    s, n, r = t("supplier"), t("nation"), t("region")
    emission = F.concat(F.lit("radar of nation_"), F.col("s_nationkey").cast("string"))
    nodes = [
        s.select(ident("s", "s_suppkey").alias("id"), labels("Contact"), F.col("s_name").alias("name"), none.alias("props")),
        s.select(ident("o", "s_suppkey").alias("id"), labels("Observation"), no_name, F.when(F.col("s_suppkey") % 4 == 0, F.create_map(F.lit("speed"), F.lit("1"))).otherwise(F.create_map(F.lit("age_seconds"), (F.col("s_suppkey") % 100).cast("string"))).alias("props")),
        s.select(ident("e", "s_suppkey").alias("id"), labels("Emission"), no_name, F.create_map(F.lit("sensor_name"), emission).alias("props")),
        n.select(ident("q", "n_nationkey").alias("id"), labels("Source"), no_name, F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("reliability"), (F.col("n_nationkey") / 25).cast("string"))).otherwise(none).alias("props")),
        n.select(ident("n", "n_nationkey").alias("id"), labels("PlatformClass"), F.col("n_name").alias("name"), none.alias("props")),
        r.select(ident("r", "r_regionkey").alias("id"), labels("Entity"), F.col("r_name").alias("name"), none.alias("props")),
    ]
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(f"{kind}|"), ident(a, ka), F.lit("|"), F.lit(b), kb.cast("string")).alias("eid"), ident(a, ka).alias("src"), F.concat(F.lit(b), kb.cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("predicate"), none.alias("props"))
    edges = [
        edge(s, "s", "s_suppkey", "n", F.col("s_nationkey"), "CLASSIFIED_AS"),
        edge(s, "s", "s_suppkey", "o", F.col("s_suppkey"), "HAS_OBSERVATION"),
        edge(s, "s", "s_suppkey", "e", F.col("s_suppkey"), "EMITTED"),
        edge(s, "o", "s_suppkey", "q", F.col("s_nationkey"), "DERIVED_FROM"),
        edge(n, "n", "n_nationkey", "r", F.col("n_regionkey"), "LOCATED_IN"),
        edge(n, "n", "n_nationkey", "n", (F.col("n_nationkey") + 1) % 25, "CONTRADICTS"),
    ]
    for k in range(1, len(nodes)):
        nodes[0] = nodes[0].unionByName(nodes[k])
        edges[0] = edges[0].unionByName(edges[k]) if k < len(edges) else edges[0]
    names = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    asked = lambda name: names.select(F.lit("s").alias("scenario_id"), ident("s", "s_suppkey").alias("contact_id"), F.lit("t").alias("observation_time"), F.col(name).alias("hypothesis"))
    return asked("n_name").unionByName(asked("r_name")), nodes[0], edges[0]
