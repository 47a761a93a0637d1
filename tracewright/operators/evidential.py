"""The evidential head: relational convolutions, Dirichlet findings, losses, texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed import ADVICE, GRAPH_RELATIONS, WARNING
from tracewright.functions.probability import digamma, dirichlet_summary, evidential, lgamma


def findings(df: DataFrame, alpha: str = "alpha", labels: str = "labels") -> DataFrame:
    """df with finding: the summary of each row's alphas. Fewer than two, other widths, bad values: errors."""
    a = F.col(alpha)
    bad = (F.size(a) < 2) | (F.size(a) != F.size(labels)) | F.exists(a, lambda x: x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")))
    checked = df.withColumn("_a", F.when(bad, F.raise_error(F.lit("alphas must be positive, finite, two or more, one a label")).cast("array<double>")).otherwise(a))
    return checked.withColumn("finding", F.struct(*(c.alias(n) for n, c in dirichlet_summary(F.col("_a"), F.col(labels)).items()))).drop("_a")


def forward(df: DataFrame, logits: str = "logits") -> DataFrame:
    """df with evidence, alpha, probabilities, belief and ignorance of its logits."""
    out = df
    for name, c in evidential(F.col(logits)).items():
        out = out.withColumn(name, c)
    return out


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def narratives(df: DataFrame) -> DataFrame:
    """df(finding, supporting_evidence, contradicting_evidence, missing_evidence: lists of text) with
    recommended_collection, decision_warning and narrative."""
    f = F.col("finding")
    empty = F.array().cast("array<string>")
    have = lambda c: F.coalesce(F.col(c), empty) if c in df.columns else empty
    advice = F.array(*(F.lit(x) for x in ADVICE))
    actions = F.array_distinct(F.concat(have("missing_evidence"), F.when(f["extreme_uncertainty"], advice).otherwise(empty)))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(have(c), "; "), F.lit("")), F.lit("none supplied"))
    text = F.concat(
        F.lit("Most likely emitter: "), f["emitter"], F.lit(" (hypothesis), probability "), _percent(f["probability"]),
        F.lit(". Confidence is "), f["confidence_band"], F.lit(": DS committed belief is "), _percent(f["belief_mass"]),
        F.lit(", uncommitted/ignorance mass is "), _percent(f["ignorance_mass"]), F.lit(", Dirichlet strength is "), F.format_string("%.2f", f["dirichlet_strength"]),
        F.lit(", normalized entropy is "), F.format_string("%.2f", f["normalized_entropy"]), F.lit(", and the lead over "), f["runner_up"], F.lit(" is "), _percent(f["probability_margin"]),
        F.lit(". Supporting evidence: "), listed("supporting_evidence"), F.lit(". Contradicting evidence: "), listed("contradicting_evidence"), F.lit("."),
        F.when(f["extreme_uncertainty"], F.concat(F.lit(" Identification is unreliable at this uncertainty level. Recommended collection: "), F.array_join(actions, " "))).otherwise(""),
        F.lit(f" {WARNING}"),
    )
    return df.withColumn("recommended_collection", actions).withColumn("decision_warning", F.lit(WARNING)).withColumn("narrative", text)


def kl_to_uniform(alpha: list[float]) -> float:
    """Kullback-Leibler divergence of a Dirichlet distribution from the uniform one."""
    s = sum(alpha)
    return lgamma(s) - sum(map(lgamma, alpha)) - lgamma(len(alpha)) + sum((a - 1) * (digamma(a) - digamma(s)) for a in alpha)


def loss(alpha: list[float], target: int, annealing: float = 0.1) -> float:
    """Expected cross entropy plus the annealed divergence of the other classes' evidence."""
    rest = [1.0 if i == target else a for i, a in enumerate(alpha)]
    return digamma(sum(alpha)) - digamma(alpha[target]) + annealing * kl_to_uniform(rest)


def with_loss(df: DataFrame, annealing: float = 0.1) -> DataFrame:
    """df(alpha, target) with kl and loss."""

    def kl(alpha: pd.Series) -> pd.Series:
        return alpha.map(lambda a: kl_to_uniform(list(a)))

    def total(alpha: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([loss(list(a), int(t), annealing) for a, t in zip(alpha, target, strict=True)], dtype=float)

    return df.withColumn("kl", F.pandas_udf(kl, "double")("alpha")).withColumn("loss", F.pandas_udf(total, "double")("alpha", "target"))


def validate_relations(edges: DataFrame, n_relations: int = len(GRAPH_RELATIONS)) -> None:
    """Every edge of edges(src, dst, rel) has one relation within the vocabulary."""
    if not edges.filter(F.col("rel").isNull() | (F.col("rel") < 0) | (F.col("rel") >= n_relations)).isEmpty():
        raise ValueError("an edge has no relation of the vocabulary")


def convolve(nodes: DataFrame, edges: DataFrame, weights: np.ndarray, root: np.ndarray, bias: np.ndarray, relu: bool = True) -> DataFrame:
    """One relational convolution of nodes(id, x): root @ x, plus for each relation its weights @ the mean of the
    neighbours' x, plus the bias. weights: relations x in x out (combine bases beforehand).

    Means are built-in aggregates by (dst, rel, component), so that a hub's messages are combined before the shuffle.
    """
    parts = edges.join(nodes.select(F.col("id").alias("src"), "x"), "src").select("dst", "rel", F.posexplode("x").alias("i", "v"))
    means = parts.groupBy("dst", "rel", "i").agg(F.avg("v").alias("v"))
    vectors = means.groupBy("dst", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    listed = vectors.groupBy(F.col("dst").alias("id")).agg(F.collect_list(F.struct("rel", "m")).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, messages in zip(b["x"], b["messages"], strict=True):
                h = np.asarray(x) @ root + bias
                for m in messages if messages is not None else []:
                    h = h + np.asarray(m["m"]) @ weights[m["rel"]]
                out.append((np.maximum(h, 0) if relu else h).tolist())
            yield pd.DataFrame({"id": b["id"], "x": out})

    return nodes.join(listed, "id", "left").select("id", "x", "messages").mapInPandas(run, f"id {nodes.schema['id'].dataType.simpleString()}, x array<double>")


def infer(nodes: DataFrame, edges: DataFrame, layers: list[dict], classifier: dict) -> DataFrame:
    """nodes' findings' inputs: convolutions with relu, then a linear layer to logits, then the evidential head."""
    validate_relations(edges)
    h = nodes
    for layer in layers:
        h = convolve(h, edges, layer["weights"], layer["root"], layer["bias"])
    w, b = np.asarray(classifier["weights"], float), np.asarray(classifier["bias"], float)
    dots = [sum((F.col("x")[i] * float(w[i, k]) for i in range(w.shape[0])), F.lit(float(b[k]))) for k in range(w.shape[1])]
    return forward(h.select("id", F.array(*dots).alias("logits")))
