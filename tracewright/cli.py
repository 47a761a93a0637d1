"""Command line: python -m tracewright COMMAND. Graphs are folders with nodes and edges as Parquet."""

from __future__ import annotations

import argparse
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.fixed import FEATURE_WEIGHTS, default_countries
from tracewright.functions.probability import linear_logit, softmax
from tracewright.operators import calibration, candidates, dataset, explain, facts, graph, hypotheses, observations, trails
from tracewright.session import local_session
from tracewright.sources import files, logs


def _countries(path: str | None) -> list[str]:
    """Country names, one a line, upper-cased and squeezed."""
    if not path:
        return default_countries()
    with open(path, encoding="utf-8") as f:
        return sorted({re.sub(r"\s+", " ", x.strip()).upper() for x in f if x.strip()})


def _read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _write_graph(spark: SparkSession, path: str, new: tuple[DataFrame, DataFrame], replace: bool) -> dict[str, int]:
    """Merges with the graph at path, unless it is to be replaced; the new one is complete before it takes its place."""
    parts = [new] if replace or not os.path.exists(f"{path}/nodes") else [_read_graph(spark, path), new]
    nodes, edges = graph.merge_graphs(*parts)
    for name, df in (("nodes", graph.unique_nodes(nodes)), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}.new")
    counts = {}
    for name in ("nodes", "edges"):
        spark.read.parquet(f"{path}/{name}.new").write.mode("overwrite").parquet(f"{path}/{name}.done")
        counts[name] = spark.read.parquet(f"{path}/{name}.done").count()
    import shutil

    for name in ("nodes", "edges"):
        shutil.rmtree(f"{path}/{name}", ignore_errors=True)
        os.replace(f"{path}/{name}.done", f"{path}/{name}")
        shutil.rmtree(f"{path}/{name}.new", ignore_errors=True)
    return counts


def fit(spark: SparkSession, a: argparse.Namespace) -> dict:
    classes, rows = files.read_examples(spark, a.input)
    model = calibration.fit(rows, classes)
    files.write_model(model, a.model)
    return {"model": a.model, "temperature": model["temperature"], "samples": rows.count()}


def _same_classes(classes: list[str], model: dict) -> None:
    if classes != model["classes"]:
        raise ValueError("the input's classes are not the model's")


def apply(spark: SparkSession, a: argparse.Namespace) -> dict:
    model = files.read_model(a.model)
    classes, rows = files.read_examples(spark, a.input, require_truth=False)
    _same_classes(classes, model)
    out = calibration.apply(rows, model)
    names = F.array(*(F.lit(c) for c in classes))
    out = out.select(F.col("text").alias("record"), F.map_from_arrays(names, "probabilities").alias("probabilities"), "prediction", "confidence")
    files.write_jsonl(out, a.output)
    return {"output": a.output, "records": rows.count()}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    model = files.read_model(a.model)
    classes, rows = files.read_examples(spark, a.input)
    _same_classes(classes, model)
    report = lambda df: calibration.report(df, a.bins).first().asDict(recursive=True)
    return {"raw": report(rows.withColumn("probabilities", softmax(F.col("logits")))), "calibrated": report(calibration.apply(rows, model))}


def ingest_graph(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Facts to the graph; with --pages and --replies from documents and their completions."""
    if a.facts:
        found = files.read_facts(spark, a.facts).withColumn("seq", F.col("line").cast("long")).drop("line")
    else:
        pages = spark.read.json(a.pages)
        docs = files.read_pages(pages).withColumn("text", facts.html_text(F.col("html")))
        replies = spark.read.json(a.replies)
        found = facts.extract_facts(docs, replies, a.chunk_size, a.overlap)
        found = found.withColumn("seq", F.col("chunk_index").cast("long") * 100_000 + F.col("fact_index")).drop("chunk_index", "fact_index")
    if a.facts_jsonl:
        files.write_jsonl(found, a.facts_jsonl)
    return _write_graph(spark, a.graph, graph.fact_graph(found, _countries(a.countries)), a.replace) | {"facts": found.count()}


def ingest_observations(spark: SparkSession, a: argparse.Namespace) -> dict:
    seen = observations.parse_observations(files.read_lines(spark, a.input))
    if a.observations_jsonl:
        plain = seen.select(*(F.to_json(c).alias(c) if c in ("time", *observations.MIXED) else F.col(c) for c in seen.columns))
        files.write_jsonl(plain, a.observations_jsonl)
    return _write_graph(spark, a.graph, observations.observation_graph(seen), a.replace) | {"observations": seen.count()}


def extract_features(spark: SparkSession, a: argparse.Namespace) -> dict:
    nodes, edges = _read_graph(spark, a.graph)
    requests = files.read_feature_requests(spark, a.requests)
    out = trails.normalise_features(trails.neighbourhood_features(requests, nodes, graph.as_edges(edges), a.hops))
    if a.include_logit:
        out = out.withColumn("feature_logit", linear_logit({n: F.col(n) for n in FEATURE_WEIGHTS}))
    files.write_jsonl(out, a.output)
    return {"output": a.output, "features": requests.count()}


def probability_model(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = candidates.candidates_from_records(files.read_jsonl(spark, a.input), countries=_countries(a.countries))
    model = files.read_model(a.model) if a.model else None
    out = candidates.probability_records(rows, model=model)
    files.write_jsonl(out, a.output)
    return {"output": a.output, "records": spark.read.text(a.output).count()}


RECORD = "scenario_id string, contact_id string, observation_time string, top_platform string, top_platform_probability double, top_operator_nation string, top_operator_nation_probability double, platform_probabilities array<struct<name:string,p:double>>, operator_nation_probabilities array<struct<name:string,p:double>>, supporting_evidence array<struct<text:string,source:string>>, contradicting_evidence array<struct<text:string,source:string>>, missing_evidence array<struct<text:string,source:string>>"


def explain_records(spark: SparkSession, a: argparse.Namespace) -> dict:
    records = spark.read.schema(RECORD).json(a.input)
    files.write_jsonl(explain.explanation_payloads(records), a.output)
    return {"output": a.output, "explanations": records.count()}


def generate_hypotheses(spark: SparkSession, a: argparse.Namespace) -> dict:
    nodes, edges = _read_graph(spark, a.graph)
    if a.list_relationship_types:
        return {"relationship_types": [r.asDict() for r in graph.relationship_counts(edges).collect()]}
    obs = spark.createDataFrame([("o", a.emitter, a.target_type, a.speed, a.altitude)], "observation_id string, emission_sensor_name string, emission_target_type string, emission_speed double, emission_altitude double")
    rows = hypotheses.graph_rows(obs, nodes, graph.as_edges(edges), a.relationship_type)
    found = hypotheses.hypotheses(rows, obs, a.n, _countries(a.countries))
    chosen = hypotheses.select_offline(obs, found, a.n).orderBy("rank")
    return {"hypotheses": [r.asDict(recursive=True) for r in chosen.collect()]}


def build_dataset(spark: SparkSession, a: argparse.Namespace) -> dict:
    fields = a.label_fields.split(",")
    if a.from_log:
        found = logs.recover_records(files.read_lines(spark, a.input)).select(F.lit(",".join(a.input)).alias("path"), "line", F.col("canonical").alias("text"), "record")
    else:
        found = files.read_jsonl(spark, a.input)
    examples = dataset.build_examples(found, fields)
    if a.drop_unknown:
        examples = dataset.drop_unknown(examples)
    labels = {r.label: r["index"] for r in dataset.label_map(examples).collect()}
    split = dataset.split_by_hash(examples, "id", a.train, a.val, a.seed)
    sizes = {"train": 0, "val": 0, "test": 0} | {r.split: r.n for r in dataset.split_sizes(split).collect()}
    manifest = dataset.manifest(sizes, len(labels), a.input, fields)
    files.write_dataset(split.drop("raw"), a.output, manifest, labels)
    return manifest


def recover_log(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = logs.recover_records(files.read_lines(spark, a.input), a.unique).orderBy("line", "nth")
    found.select(F.col("canonical").alias("value")).write.mode("overwrite").text(a.output)
    return {"output": a.output, "records": spark.read.text(a.output).count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    commands = p.add_subparsers(required=True)

    def add(name: str, handler, *arguments: tuple) -> None:
        c = commands.add_parser(name, help=(handler.__doc__ or "").split("\n")[0] or None)
        for names, options in arguments:
            c.add_argument(*names, **options)
        c.set_defaults(handler=handler)

    def arg(*names: str, **options) -> tuple:
        return names, options

    countries, replace, graph_at = arg("--countries", help="file of country names, one a line"), arg("--replace", action="store_true"), arg("--graph", required=True)
    add("fit", fit, arg("input"), arg("model"))
    add("apply", apply, arg("model"), arg("input"), arg("output"))
    add("evaluate", evaluate, arg("model"), arg("input"), arg("--bins", type=int, default=10))
    add("ingest-graph", ingest_graph, arg("--facts"), arg("--pages"), arg("--replies"), arg("--chunk-size", type=int, default=6000), arg("--overlap", type=int, default=500), arg("--facts-jsonl"), graph_at, countries, replace)
    add("ingest-observations", ingest_observations, arg("--input", required=True), arg("--observations-jsonl"), graph_at, replace)
    add("extract-features", extract_features, arg("--requests", required=True), arg("--output", required=True), arg("--include-logit", action="store_true"), arg("--hops", type=int, default=4), graph_at)
    add("probability-model", probability_model, arg("input"), arg("output"), arg("--model"), countries)
    add("explain", explain_records, arg("input"), arg("output"))
    add("generate-hypotheses", generate_hypotheses, arg("--emitter", default=""), arg("--target-type", default=""), arg("--speed", type=float), arg("--altitude", type=float), arg("-n", type=int, default=5), arg("--relationship-type", action="append"), arg("--list-relationship-types", action="store_true"), graph_at, countries)
    add("build-dataset", build_dataset, arg("--input", nargs="+", required=True), arg("--output", required=True), arg("--label-fields", default=",".join(dataset.LABEL_FIELDS)), arg("--train", type=float, default=0.7), arg("--val", type=float, default=0.15), arg("--seed", type=int, default=1), arg("--drop-unknown", action="store_true"), arg("--from-log", action="store_true"))
    add("recover-log", recover_log, arg("input"), arg("output"), arg("--unique", action="store_true"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    out = a.handler(spark or local_session(), a)
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return out
