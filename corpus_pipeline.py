"""A corpus from raw documents to token ids: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes all that its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, langid, line_dedup, simhash
from tracewright.llm.common import keep_until_release, mark, release, shared_dir

RANKS = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter go, and no others, also where no language can be learned.

    Documents whose lang is null get the predicted one, unless it is ambiguous.
    """
    model = langid.train(langid.sample(docs))
    if not model.langs:
        return langid.lettered(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("words"))
    found = langid.predict(rows, model, "words").filter("lang_pred <> 'und'")
    lang = F.coalesce(F.col("row.lang"), F.when(~F.col("ambiguous"), F.col("lang_pred")).cast(docs.schema["lang"].dataType))
    return found.select(*((lang if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that lose all their lines go. n_chars follows."""
    out = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: one passage is a leak, unlike in op8's report, which asks for two items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the bytes decoded from them."""
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)



def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, first deleting what earlier stages stored on the way: their results have been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for app, start, end in HELD:
            if app == spark.sparkContext.applicationId:
                release(spark, start, end)
        HELD.clear()
        start = mark(spark)
        out = stage(spark, docs, sf_dir)
        HELD.append((spark.sparkContext.applicationId, start, mark(spark)))
        return out

    return run_stage


#: What the latest stage has stored on its way, as marks.
HELD: list[tuple[str, int, int]] = []

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(f.__name__, staged(f)) for f in (language, lines, near_duplicates, benchmarks, encoding)]

#: Classifiers, fingerprints and encodings are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    held = mark(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        release(spark, held, mark(spark))  # all that the stage has read, its input among it
        held = mark(spark)
        keep_until_release(spark, f"{at}/{name}")
    return docs
