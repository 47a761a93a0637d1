"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks. Every block of queries meets every block of candidates in one task, which
scores them with a matrix product; scores are recomputed in each round rather than stored. Round by round the kth score
of each query is located: the tasks count scores per histogram bin, the counts are summed over all tasks, and the bin
that holds the kth score becomes the next round's range. With 2**BITS bins a round, the score is known exactly when bins
are one score wide. A last pass keeps scores above it, and of those equal to it the smallest ids.

A task sends no more than k bins a query and round: bins below its own kth score cannot hold the global one. So the
shuffle is in proportion to queries x blocks x k, whatever the ties. No candidate is dropped and nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, session, tidy

#: Queries and candidates a block, and bits of the score settled in a round.
QUERY_BLOCK, ROW_BLOCK, BITS = 1024, 8192, 11
#: Components beyond this take the slower integer product, as doubles would round.
EXACT = 1 << 53

OUT = "query_id long, rank int, vec_id long, score long"


def _pack(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Blocks of up to rows vectors: ids and integer components as raw arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            full = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                full[i, : len(v)] = v
            block = pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary())], names=["n", "ids", "vectors"])
            ids.clear()
            vectors.clear()
            return block

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield out()
        if ids:
            yield out()

    packed = df.mapInArrow(tidy(run), "n long, ids binary, vectors binary")
    return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in packed.columns))


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and their scores; a query's own row scores lowest of all, and is left out later."""
    qi, vi = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
    q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(qi), -1)
    v = np.frombuffer(row["v_vectors"], np.int64).reshape(len(vi), -1)
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width
    return qi, vi, (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < EXACT else q @ v.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest scores, ties to the smaller id.

    Components become floor(scale * x); the score is their integer inner product, and shorter vectors count as padded
    with zeros. vectors and queries have the columns id_col and vector_col (extra columns are left out). A query's own
    id is no candidate. Vectors that are null or hold nulls or non-finite values take no part, nor do null ids; one
    without any component scores 0 with all. Of repeated rows (one id and vector) one is used. Queries with fewer than k candidates return all; empty
    tables return no rows. Scores beyond 2**62 are not supported.
    """
    spark = session(vectors)
    sizes = spark.conf.get("spark.sql.shuffle.partitions")

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")).dropDuplicates()

    # Blocks are used in every round: written once to the shared folder.
    asked = cut(_pack(clean(queries), "q", QUERY_BLOCK).withColumn("qb", F.monotonically_increasing_id()))
    rows = cut(_pack(clean(vectors), "v", ROW_BLOCK).withColumn("vb", F.monotonically_increasing_id()))
    # The grid of blocks: each query block is copied to the groups of candidate blocks, and each of those to all
    # query blocks of its group's task.
    n_blocks = rows.count()
    groups = max(1, min(n_blocks, int(sizes)))
    grid = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(rows.withColumn("g", F.pmod(F.col("vb") % 8589934592 + F.shiftright("vb", 33), F.lit(groups)).cast("int")), "g")
    ids = asked.select("qb", "q_ids").mapInArrow(tidy(_unpacked), "qb long, query_id long")

    # No score is beyond the largest squared length (one number, from all vectors).
    squared = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("m")).first().m or 0.0
    bits = min(62, int(math.sqrt(squared(clean(queries))) * math.sqrt(squared(clean(vectors))) * 1.001 + 1).bit_length())
    low, width = -(1 << bits), 2 << bits
    # want: how many of the scores from the bin of the kth down to it are still to be found.
    state = ids.withColumn("low", F.lit(low)).withColumn("want", F.lit(k).cast("long"))
    while width > 1:
        bin_width = max(1, width >> BITS)
        packed = state.groupBy("qb").applyInPandas(_pack_state, "qb long, s_ids binary, s_low binary")
        counts = grid.join(packed, "qb").mapInArrow(tidy(_counter(width, bin_width, k)), "query_id long, bin int, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        found = counts.join(state, "query_id").withColumn("upto", F.sum("n").over(w)).filter("upto >= want and upto - n < want")
        settled = found.select("query_id", "bin", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
        # Without k candidates there is no kth score: the lowest possible one keeps all.
        state = state.join(settled, "query_id", "left").select("qb", "query_id", F.expr(f"case when bin is null then low else low + bin * {bin_width}L end").alias("low"), F.coalesce("left", "want").alias("want"))
        state = cut(state)
        width = bin_width
    packed = state.groupBy("qb").applyInPandas(_pack_state, "qb long, s_ids binary, s_low binary")
    kept = grid.join(packed, "qb").mapInArrow(tidy(_keeper(k)), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for qb, raw in zip(batch.column("qb").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
            own = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qb)), pa.array(own)], names=["qb", "query_id"])


def _pack_state(pdf: pd.DataFrame) -> pd.DataFrame:
    """The bounds of one block's queries."""
    pdf = pdf.sort_values("query_id")
    return pd.DataFrame({"qb": [pdf.qb.iloc[0]], "s_ids": [pdf.query_id.to_numpy(np.int64).tobytes()], "s_low": [pdf.low.to_numpy(np.int64).tobytes()]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            qi, vi, scores = _scores(row)
            s = np.frombuffer(row["s_ids"], np.int64)
            low = np.frombuffer(row["s_low"], np.int64)[np.searchsorted(s, qi)]
            yield qi, vi, scores, low


def _counter(width: int, bin_width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, vi, scores, low in _blocks(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for i, q in enumerate(qi):
                s = scores[i][vi != q] - low[i]
                s = s[(s >= 0) & (s < width)] if width < 1 << 63 else s
                if len(s) > k:  # lower bins cannot hold the kth score
                    s = s[s >= np.partition(s, len(s) - k)[len(s) - k] // bin_width * bin_width]
                bins, n = np.unique(s // bin_width, return_counts=True)
                for to, x in zip(out, (np.full(len(bins), q), bins.astype(np.int32), n.astype(np.int64)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "bin", "n"])

    return run


def _keeper(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, vi, scores, low in _blocks(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for i, q in enumerate(qi):
                at = np.flatnonzero((scores[i] >= low[i]) & (vi != q))
                at = at[np.lexsort((vi[at], -scores[i][at]))[:k]]
                for to, x in zip(out, (np.full(len(at), q), vi[at], scores[i][at]), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    return run
