"""Temperature scaling: report, loss over a grid, fit, apply."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.probability import argmax, log_loss, softmax, total

#: Temperatures of one round, and rounds: each narrows the bracket by a factor of about 12.
GRID, ROUNDS, LOW, HIGH = 24, 9, 0.05, 20.0


def validate_logits(df: DataFrame) -> int:
    """The width of the logits of df(logits, label); widths that differ, values that aren't finite, bad labels: errors."""
    bad = F.exists("logits", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = df.agg(F.count("*").alias("n"), F.min(F.size("logits")).alias("low"), F.max(F.size("logits")).alias("high"), F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("bad"), F.min("label").alias("first"), F.max("label").alias("last"), F.count("label").alias("labels")).first()
    if not r.n:
        raise ValueError("no rows")
    if r.low != r.high or r.low < 2:
        raise ValueError("all rows need the same two or more classes")
    if r.bad:
        raise ValueError("logits must be finite")
    if r.labels != r.n or r["first"] < 0 or r["last"] >= r.low:
        raise ValueError("a label is no class")
    return r.low


def nll(df: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, nll (mean) and n, in one pass: rows are combined for each temperature before the shuffle."""
    grid = F.array(*(F.lit(float(t)) for t in temperatures))
    p = lambda t: F.get(softmax(F.col("logits"), t), F.col("label"))
    rows = df.select(F.posexplode(F.transform(grid, lambda t: log_loss(p(t)))).alias("i", "loss"))
    means = rows.groupBy("i").agg(F.avg("loss").alias("nll"), F.count("*").alias("n"))
    return means.select(F.get(grid, F.col("i")).alias("temperature"), "nll", "n")


def fit(df: DataFrame, classes: list[str] | None = None, low: float = LOW, high: float = HIGH) -> dict:
    """The model whose temperature has the least mean loss over df(logits, label).

    Rounds over a grid of log temperatures around the best one so far (only the grid's sums come to the driver); of
    equal minima the highest temperature counts.
    """
    if low <= 0 or high <= low:
        raise ValueError("bad temperature bounds")
    width = validate_logits(df)
    names = classes or [str(i) for i in range(width)]
    if len(names) != width or len(set(names)) != width:
        raise ValueError("classes must be distinct and as many as logits")
    own = df.select("logits", "label").cache()
    a, b = math.log(low), math.log(high)
    try:
        for _ in range(ROUNDS):
            step = (b - a) / (GRID - 1)
            points = [a + step * i for i in range(GRID)]
            rows = sorted((r.temperature, r.nll) for r in nll(own, [math.exp(x) for x in points]).collect())
            best = min(x[1] for x in rows)
            i = max(k for k, x in enumerate(rows) if x[1] <= best)
            a, b = points[max(0, i - 1)], points[min(GRID - 1, i + 1)]
            if b - a < 1e-12:
                break
    finally:
        own.unpersist()
    return {"method": "temperature_scaling", "classes": names, "temperature": math.exp((a + b) / 2)}


def apply(df: DataFrame, model: dict) -> DataFrame:
    """df with probabilities, prediction (the first of equal ones by class order) and confidence."""
    p = softmax(F.col("logits"), model["temperature"])
    checked = F.when(F.size("logits") != len(model["classes"]), F.raise_error(F.lit("logits do not match the model's classes")).cast("array<double>")).otherwise(p)
    out = df.withColumn("probabilities", checked)
    names = F.array(*(F.lit(c) for c in model["classes"]))
    return out.withColumn("prediction", F.get(names, argmax(F.col("probabilities")))).withColumn("confidence", F.array_max("probabilities"))


def check_probabilities(p: Column, label: Column) -> Column:
    """p, or an error where it is no distribution over two and more classes with the label among them."""
    bad = (F.size(p) < 2) | label.isNull() | (label < 0) | (label >= F.size(p)) | F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) | (F.abs(total(p) - 1.0) > F.greatest(F.lit(1e-7), 1e-7 * total(p)))
    return F.when(bad, F.raise_error(F.lit("invalid probabilities or label")).cast("array<double>")).otherwise(p)


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """bucket, lower, upper, count, mean_confidence, observed_accuracy, and sums of loss and Brier score, of df(probabilities, label)."""
    if bins < 1:
        raise ValueError("bins must be positive")
    p = check_probabilities(F.col("probabilities"), F.col("label"))
    rows = df.select(p.alias("p"), "label")
    rows = rows.select(
        F.array_max("p").alias("confidence"),
        (argmax(F.col("p")) == F.col("label")).cast("int").alias("hit"),
        log_loss(F.get("p", "label")).alias("loss"),
        total(F.transform("p", lambda x, i: F.pow(x - (i == F.col("label")).cast("double"), F.lit(2.0)))).alias("brier"),
    )
    bucket = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("observed_accuracy"), F.sum("hit").cast("long").alias("hits"), F.sum("loss").alias("loss"), F.sum("brier").alias("brier"))
    return out.withColumn("lower", F.col("bucket") / bins).withColumn("upper", (F.col("bucket") + 1) / bins)


def report(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row: samples, accuracy, log_loss, brier_score, expected_calibration_error, reliability_bins."""
    r = reliability(df, bins)
    n = F.sum("count")
    details = F.array_sort(F.collect_list(F.struct("lower", "upper", "count", "mean_confidence", "observed_accuracy")))
    return r.agg(
        n.alias("samples"),
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("brier") / n).alias("brier_score"),
        (F.sum(F.col("count") * F.abs(F.col("mean_confidence") - F.col("observed_accuracy"))) / n).alias("expected_calibration_error"),
        details.alias("reliability_bins"),
    )
