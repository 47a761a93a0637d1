"""The evidence graph as two tables.

nodes(id, labels array, name, aliases array, props map) and edges(eid, src, dst, type, predicate, props map). Facts
append; entities, sources and typed edges are upserts, where the last fact (by seq) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions.names import canonical_name, is_country
from tracewright.functions.values import node_id

TYPED = sorted({*fixed.PLATFORM_PREDICATES, *fixed.SENSOR_PREDICATES, *fixed.OPERATOR_PREDICATES, *fixed.COUNTRY_PREDICATES, *fixed.LOCATION_PREDICATES, *fixed.OTHER_PREDICATES})


def compatible(predicate: Column, subject: Column, obj: Column, countries: list[str]) -> Column:
    """Whether a typed relation would not give its ends impossible labels."""
    s, o = is_country(subject, countries), is_country(obj, countries)
    return (
        F.when(predicate.isin("HAS_SENSOR", "USES_RADAR", "HAS_EMITTER"), ~s & ~o)
        .when(predicate.isin(fixed.COUNTRY_PREDICATES), o)
        .when(predicate.isin(fixed.OPERATOR_PREDICATES), ~s)
        .when(predicate.isin("VARIANT_OF", "HAS_VARIANT", "HAS_PLATFORM"), s == o)
        .otherwise(True)
    )


def _labels(predicate: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return F.array_compact(F.array(F.lit("ReferenceEntity"), *(F.when(predicate.isin(p), label) for label, p in rules)))


SUBJECT_RULES = [("Platform", fixed.PLATFORM_PREDICATES), ("Sensor", fixed.SENSOR_SUBJECT_PREDICATES)]
OBJECT_RULES = [("Platform", fixed.PLATFORM_OBJECT_PREDICATES), ("Sensor", fixed.SENSOR_PREDICATES), ("Operator", fixed.OPERATOR_PREDICATES), ("Country", fixed.COUNTRY_PREDICATES), ("Location", fixed.LOCATION_PREDICATES)]


def with_ends(facts: DataFrame, countries: list[str]) -> DataFrame:
    """facts with canonical names and ids of both ends, and typed: whether a typed edge is due."""
    out = facts.withColumn("s_name", canonical_name(F.col("subject"))).withColumn("o_name", canonical_name(F.col("object")))
    out = out.withColumn("s_id", node_id("entity", F.lower("s_name"))).withColumn("o_id", node_id("entity", F.lower("o_name")))
    return out.withColumn("typed", F.col("predicate").isin(TYPED) & compatible(F.col("predicate"), F.col("subject"), F.col("object"), countries))


def fact_graph(facts: DataFrame, countries: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of facts(seq, subject, predicate, object, source_id, source_type, locator, evidence, confidence).

    Each fact is an edge of type FACT; both ends are MENTIONED_IN their source, once. A known predicate whose ends fit
    gives one typed edge for each pair of ends, and labels.
    """
    f = with_ends(facts, countries if countries is not None else fixed.default_countries())
    ends = F.array(
        F.struct(F.col("s_id").alias("id"), F.col("s_name").alias("name"), F.col("subject").alias("raw"), F.when(F.col("typed"), _labels(F.col("predicate"), SUBJECT_RULES)).otherwise(F.array().cast("array<string>")).alias("labels"), (F.col("seq") * 2).alias("at")),
        F.struct(F.col("o_id").alias("id"), F.col("o_name").alias("name"), F.col("object").alias("raw"), F.when(F.col("typed"), _labels(F.col("predicate"), OBJECT_RULES)).otherwise(F.array().cast("array<string>")).alias("labels"), (F.col("seq") * 2 + 1).alias("at")),
    )
    e = f.select(F.explode(ends).alias("e")).select("e.*")
    # Spellings and labels are few for an entity; its mentions are not. So they are made distinct before they are listed.
    spelled = e.filter("raw <> name").groupBy("id", "raw").agg(F.min("at").alias("at")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]).alias("aliases"))
    labelled = e.select("id", F.explode("labels").alias("l")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    named = e.groupBy("id").agg(F.max_by("name", "at").alias("name"))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    entities = named.join(spelled, "id", "left").join(labelled, "id", "left").select("id", F.concat(F.array(F.lit("Entity")), F.coalesce("l", none)).alias("labels"), "name", F.coalesce("aliases", none).alias("aliases"), empty.alias("props"))
    sources = f.groupBy("source_id").agg(F.max_by(F.struct("source_type", "locator"), "seq").alias("x")).select(F.col("source_id").alias("id"), F.array(F.lit("Source")).alias("labels"), F.lit(None).cast("string").alias("name"), none.alias("aliases"), F.create_map(F.lit("source_type"), F.col("x.source_type"), F.lit("locator"), F.col("x.locator")).alias("props"))
    props = F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("evidence"), F.col("evidence"), F.lit("confidence"), F.col("confidence").cast("string"))
    fact_edges = f.select(F.concat(F.lit("fact-"), F.col("seq").cast("string")).alias("eid"), F.col("s_id").alias("src"), F.col("o_id").alias("dst"), F.lit("FACT").alias("type"), "predicate", props.alias("props"))
    mentions = f.select(F.explode(F.array("s_id", "o_id")).alias("src"), F.col("source_id").alias("dst")).distinct().select(_edge_id("MENTIONED_IN"), "src", "dst", F.lit("MENTIONED_IN").alias("type"), F.lit(None).cast("string").alias("predicate"), empty.alias("props"))
    typed = f.filter("typed").groupBy("s_id", "o_id", "predicate").agg(F.max_by(F.struct("source_id", "evidence", "confidence"), "seq").alias("x")).select(F.col("s_id").alias("src"), F.col("o_id").alias("dst"), F.col("predicate").alias("type"), "x.*")
    typed = typed.select(F.concat_ws("|", F.lit("typed"), "src", "type", "dst").alias("eid"), "src", "dst", "type", F.lit(None).cast("string").alias("predicate"), props.alias("props"))
    return entities.unionByName(sources), fact_edges.unionByName(mentions).unionByName(typed)


def _edge_id(kind: str) -> Column:
    return F.concat_ws("|", F.lit(kind), "src", "dst").alias("eid")


def as_edges(edges: DataFrame) -> DataFrame:
    """edges with the columns eid and predicate, where they lack them; eid is of the ends and the type."""
    if "predicate" not in edges.columns:
        edges = edges.withColumn("predicate", F.lit(None).cast("string"))
    if "eid" not in edges.columns:
        edges = edges.withColumn("eid", F.concat_ws("|", "type", "src", "dst", F.to_json("props")))
    return edges.select("eid", "src", "dst", "type", "predicate", "props")


def merge_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of several. Nodes of one id get all labels and aliases, and the last graph's name and properties."""
    nodes = edges = None
    for k, (n, e) in enumerate(graphs):
        n, e = n.withColumn("_k", F.lit(k)), as_edges(e)
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", c))), lambda x: x[c]))).alias(c)
    merged = nodes.groupBy("id").agg(listed("labels"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("_k"))).alias("name"), listed("aliases"), F.max_by(F.struct("props"), "_k").alias("p"))
    facts, others = edges.filter("type = 'FACT'"), edges.filter("type <> 'FACT'")
    return merged.select("id", "labels", "name", "aliases", "p.props"), facts.unionByName(others.dropDuplicates(["eid"]))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that more than one node has: empty, if the graph is sound."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """nodes; an id that two of them share is an error when they are written or read. Null ids count as one id."""
    counted = nodes.groupBy("id").agg(F.count("*").alias("n"), F.first(F.struct(*(c for c in nodes.columns if c != "id"))).alias("row"))
    clash = F.concat(F.lit("more than one node has the id "), F.coalesce("id", F.lit("null")))
    return counted.filter(F.assert_true(F.col("n") == 1, clash).isNull()).select("id", "row.*").select(*nodes.columns)


def relationship_counts(edges: DataFrame) -> DataFrame:
    """type and n, the most frequent first, then by name."""
    return edges.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type")


def link_by_name(nodes: DataFrame) -> DataFrame:
    """Extra edges of type SAME_NAME between nodes that share a name in lower case, by the least id of each name."""
    named = nodes.filter("name is not null").select("id", F.lower("name").alias("n"))
    least = named.groupBy("n").agg(F.min("id").alias("src"), F.count("*").alias("c")).filter("c > 1")
    out = named.join(least, "n").filter("id <> src").select("src", F.col("id").alias("dst"), F.lit("SAME_NAME").alias("type"), F.lit(None).cast("string").alias("predicate"), F.create_map().cast("map<string,string>").alias("props"))
    return out.select(_edge_id("SAME_NAME"), "src", "dst", "type", "predicate", "props")


def probe_neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50) -> DataFrame:
    """id, type and neighbour of the nodes in ids(id), over edges in either direction, by name; the first `limit`."""
    both = edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type").filter("src <> dst"))
    out = both.join(ids.select(F.col("id").alias("src")), "src").join(nodes.select(F.col("id").alias("dst"), F.coalesce("name", "id").alias("neighbour")), "dst")
    return out.select(F.col("src").alias("id"), "type", "neighbour").orderBy("id", "type", F.col("neighbour").asc_nulls_last()).limit(limit)
