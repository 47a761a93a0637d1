"""Files in and out: JSON lines with line numbers, logs, documents, examples, models."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.values import stable_id, strip


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line (from 1, over all lines of a file) and text. Bad UTF-8 becomes U+FFFD, a BOM goes.

    Files are split: lines are counted for each part of a file first, so the numbers need a second pass, but no task
    reads more than a part.
    """
    m = F.col("_metadata")
    rows = spark.read.text(paths).select(m["file_path"].alias("path"), m["file_block_start"].alias("_part"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("text"))
    # A row a part of a file: the lines before it, and the number of its first row.
    parts = rows.groupBy("path", "_part").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_part")) - F.col("_n")
    parts = parts.select("path", "_part", (before - F.col("_first") + 1).alias("_shift"))
    line = (F.col("_m") + F.col("_shift")).alias("line")
    out = rows.join(parts, ["path", "_part"]).select("path", line, "text")
    return out.withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")))


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line, record (VARIANT) and text of each non-blank line; a line that is no JSON object is an error."""
    rows = read_lines(spark, paths).filter(strip(F.col("text")) != "")
    record = F.try_parse_json("text")
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), F.col("path"), F.lit(" line "), F.col("line").cast("string")))
    # Blank lines are named here too: the optimizer may evaluate this before the filter.
    checked = F.when(strip(F.col("text")) == "", F.lit(None).cast("variant")).when(record.isNull(), bad("invalid JSON").cast("variant")).when(~F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), bad("no JSON object").cast("variant")).otherwise(record)
    return rows.select("path", "line", checked.alias("record"), "text")


def required_text(record: Column, name: str, line: Column) -> Column:
    """A field as text; missing, null, empty, zero or false is an error with the line number."""
    v = F.try_variant_get(record, f"$.{name}", "string")
    bad = v.isNull() | v.isin("", "0", "false", "0.0")
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is missing in line "), line.cast("string"))).cast("string")).otherwise(v)


def read_feature_requests(spark: SparkSession, path: str) -> DataFrame:
    """scenario_id, contact_id, observation_time and hypothesis of each request; none at all is an error."""
    rows = read_jsonl(spark, path)
    out = rows.select(*(required_text(F.col("record"), n, F.col("line")).alias(n) for n in ("scenario_id", "contact_id", "observation_time", "hypothesis")))
    if out.isEmpty():
        raise ValueError("no feature requests")
    return out


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts: six required fields, evidence and confidence with defaults, the confidence as it stands."""
    rows = read_jsonl(spark, path)
    r, line = F.col("record"), F.col("line")
    fields = [required_text(r, n, line).alias(n) for n in ("subject", "predicate", "object", "source_id", "source_type", "locator")]
    return rows.select("line", *fields, F.coalesce(F.try_variant_get(r, "$.evidence", "string"), F.lit("")).alias("evidence"), F.coalesce(F.try_variant_get(r, "$.confidence", "double"), F.lit(0.0)).alias("confidence"))


def read_examples(spark: SparkSession, path: str, require_truth: bool = True) -> tuple[list[str], DataFrame]:
    """The classes (sorted) and rows: record, logits in the classes' order, label (index of truth).

    All records need the same classes and, if asked for, a truth among them.
    """
    rows = read_jsonl(spark, path)
    scores = F.from_json(F.to_json(F.try_variant_get("record", "$.scores", "variant")), "map<string,string>")
    rows = rows.withColumn("scores", scores).withColumn("classes", F.array_sort(F.map_keys("scores"))).withColumn("truth", F.try_variant_get("record", "$.truth", "string"))
    kinds = rows.select("classes").distinct().limit(2).collect()
    if not kinds:
        raise ValueError("no records")
    if len(kinds) > 1 or not kinds[0].classes:
        raise ValueError("all records must have the same classes")
    classes = list(kinds[0].classes)
    out = rows.withColumn("logits", F.transform("classes", lambda c: F.element_at("scores", c).cast("double"))).withColumn("label", F.array_position("classes", F.col("truth")).cast("int") - 1)
    if require_truth and not out.filter("label is null or label < 0").isEmpty():
        raise ValueError("a record's truth is none of its classes")
    return classes, out.select("record", "text", "logits", "label")


def read_model(path: str) -> dict:
    """A temperature model; other methods, classes that are no texts and temperatures that are no numbers are errors."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model.get("method") != "temperature_scaling":
        raise ValueError("unsupported calibration method")
    if not isinstance(model.get("classes"), list) or not all(isinstance(c, str) for c in model["classes"]):
        raise ValueError("classes must be a list of texts")
    if isinstance(model.get("temperature"), bool) or not isinstance(model.get("temperature"), int | float):
        raise ValueError("the temperature must be a number")
    return {"method": model["method"], "classes": model["classes"], "temperature": float(model["temperature"])}


def write_model(model: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model, f, indent=2)
        f.write("\n")


def sorted_json(df: DataFrame) -> Column:
    """A row as one JSON object with its keys in alphabetical order at every level, nulls included."""

    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with sorted keys; overwrites."""
    df.select(sorted_json(df).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with a header, nulls empty; overwrites."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_dataset(examples: DataFrame, path: str, manifest: dict, label_map: dict[str, int]) -> None:
    """Splits as JSON lines under path/split=..., a flat CSV, and the two small JSON files.

    The small files go to the same store by Spark's writer.
    """
    spark = examples.sparkSession
    text = sorted_json(examples.drop("split"))
    examples.select("split", text.alias("value")).write.mode("overwrite").partitionBy("split").text(f"{path}/examples")
    flat = examples.select("id", "label", "name", "source_file", "source_line", "features.*")
    write_csv(flat, f"{path}/all_examples")
    for name, value in (("label_map", label_map), ("manifest", manifest)):
        spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/{name}")


def read_pages(pages: DataFrame) -> DataFrame:
    """Source documents of pages(url, html): source_id, source_type, locator, title and html.

    The title is what <title> holds as it stands, without a site's name after the last dash; else the url's last part.
    """
    raw = strip(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))
    title = F.regexp_replace(raw, r"\s+-\s+Wikipedia$", "")
    last = F.replace(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1), F.lit("_"), F.lit(" "))
    return pages.select(stable_id("source", F.col("url")).alias("source_id"), F.lit("web").alias("source_type"), F.col("url").alias("locator"), F.coalesce(F.nullif(title, F.lit("")), last).alias("title"), "html")


def read_pdfs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Source documents of PDF files, pages joined by blank lines; needs pypdf on the executors."""
    files = spark.read.format("binaryFile").load(paths)

    def run(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            texts = ["\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(x)).pages) for x in pdf["content"]]
            yield pd.DataFrame({"locator": pdf["path"], "title": [os.path.splitext(os.path.basename(p))[0] for p in pdf["path"]], "text": texts})

    out = files.select("path", "content").mapInPandas(run, "locator string, title string, text string")
    return out.select(stable_id("source", F.col("locator")).alias("source_id"), F.lit("pdf").alias("source_type"), "locator", "title", "text")


def union_documents(*parts: DataFrame) -> DataFrame:
    """All documents, in the order given; duplicates stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
