"""Benchmark decontamination with a distributed positional inverted index.

build_index stores, for each block of documents, the positions of every term: the terms' 64-bit hashes sorted, and for
each the ascending positions at which it occurs in the block. Positions run through the block with a gap between
documents, so that no phrase spans two. A block holds whole documents, so one task answers for them.

A phrase is found in a block from its rarest term there: its posting list, shifted by the term's offset in the phrase,
is intersected with the shifted lists of the other terms, in order of their length. A phrase with a term that the block
lacks costs one lookup. near() finds terms within a span of words in the same way.

The test items go to the tasks by broadcast in chunks of a checked size; more items mean more chunks, one search each.
The index is written once to the shared folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import as_bytes, keep_until_release, session, shared_dir, tidy
from tracewright.llm.words import Hashes, alnum_words

#: Blocks are numbered within the task that builds them by this many bits.
BLOCK_BITS = 32
#: Words a block (a longer document is a block of its own), and bytes of test items that are broadcast at once.
BLOCK_WORDS, CHUNK_BYTES = 1 << 20, 16 << 20

INDEX = "block long, doc_ids array<long>, sizes binary, terms binary, offsets binary, postings binary"
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Block:
    """Positions of the terms of some documents."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, offsets: np.ndarray, postings: np.ndarray) -> None:
        self.sizes, self.terms, self.offsets, self.postings = sizes, terms, offsets, postings
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Block:
        sizes = np.array([len(x) for x in texts], np.int64)
        all_terms = np.concatenate([*texts, np.zeros(0, np.uint64)])
        gaps = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(all_terms, kind="stable")
        found = all_terms[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return cls(sizes, found[first], np.append(first, len(found)).astype(np.uint32), (order + gaps[order]).astype(np.uint32))

    def row(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.sizes, self.terms, self.offsets, self.postings))

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.offsets[term] : self.offsets[term + 1]].astype(np.int64)

    def phrases(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """wanted: a row of term hashes for each phrase. Yields the phrases that occur, and the positions they start at."""
        if not len(self.terms) or not len(wanted):
            return
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        here = np.flatnonzero((self.terms[at] == wanted).all(1))
        at = at[here]
        rarity = np.argsort(self.offsets[at + 1] - self.offsets[at], axis=1, kind="stable")
        for k, which in enumerate(here):
            found = None
            for offset in rarity[k]:
                own = self.list_of(at[k, offset])
                if found is None:
                    found = own - offset
                    continue
                i = np.searchsorted(own, found + offset)
                i[i == len(own)] = 0
                found = found[own[i] == found + offset]
                if not len(found):
                    break
            if len(found):
                yield int(which), found

    def near(self, wanted: np.ndarray, within: int) -> np.ndarray:
        """Spans (first, last position) of at most `within` words that hold all wanted terms: one for each occurrence
        of the rarest that has the others close enough on one side or the other of a common span."""
        if not len(self.terms) or not len(wanted):
            return np.zeros((0, 2), np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        if (self.terms[at] != wanted).any():
            return np.zeros((0, 2), np.int64)
        lists = sorted((self.list_of(t) for t in at), key=len)
        out = []
        for p in lists[0].tolist():
            # The span starts at some occurrence of a term in (p - within, p]: try each, latest first.
            starts = np.unique(np.concatenate([x[np.searchsorted(x, p - within + 1) : np.searchsorted(x, p, "right")] for x in lists]))[::-1]
            doc = np.searchsorted(self.starts, p, "right")
            for s in starts.tolist():
                if np.searchsorted(self.starts, s, "right") != doc:
                    break
                i = [np.searchsorted(x, s) for x in lists]
                if any(k == len(x) for k, x in zip(i, lists, strict=True)):
                    continue
                end = max(p, *(int(x[k]) for k, x in zip(i, lists, strict=True)))
                if end - s < within and np.searchsorted(self.starts, end, "right") == doc:
                    out.append((s, end))
                    break
        return np.array(out, np.int64).reshape(-1, 2)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The index of docs(doc_id, text), written to path (else to the shared folder): a row per block."""
    spark = session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, texts, words = Hashes(), [], [], 0
        numbers = count(TaskContext.get().partitionId() << BLOCK_BITS)

        def block() -> pa.RecordBatch:
            row = Block.of(texts).row()
            out = pa.RecordBatch.from_arrays(
                [pa.array([next(numbers)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row)],
                names=["block", "doc_ids", "sizes", "terms", "offsets", "postings"],
            )
            return out

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own = hashes.of(alnum_words(text))
                if ids and words + len(own) > BLOCK_WORDS:
                    yield block()
                    ids, texts, words = [], [], 0
                ids.append(i)
                texts.append(own)
                words += len(own)
        if ids:
            yield block()

    if path is None:
        path = f"{shared_dir(spark)}/positional-index-{uuid.uuid4().hex}"
        keep_until_release(spark, path)
    docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(run), INDEX).write.option("compression", "zstd").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("sizes", np.int64), ("terms", np.uint64), ("offsets", np.uint32), ("postings", np.uint32))]
            yield batch.column("block")[i].as_py(), batch.column("doc_ids")[i].as_py(), Block(*raw)


def _windows(items: list[tuple[str, str]], width: int) -> dict[int, tuple[np.ndarray, list[list[int]], list[str]]]:
    """By length: the distinct windows, the items that each is of, and the items' ids."""
    hashes, names, found = Hashes(), sorted({i for i, _ in items}), {}
    number = {x: n for n, x in enumerate(names)}
    for item, text in items:
        own = hashes.of(alnum_words((text or "").encode()))
        size = min(width, len(own))
        if size:
            of = found.setdefault(size, {})
            for s in range(len(own) - size + 1):
                of.setdefault(own[s : s + size].tobytes(), set()).add(number[item])
    return {size: (np.frombuffer(b"".join(of), np.uint64).reshape(-1, size), [sorted(x) for x in of.values()], names) for size, of in found.items()}


def _search(index: DataFrame, items: list[tuple[str, str]], width: int) -> DataFrame:
    """A row per document: its block and place there, its words, the hit ranges, and the ids of the items that occur."""
    wanted = index.sparkSession.sparkContext.broadcast(_windows(items, width))  # of at most CHUNK_BYTES of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, block in _blocks(batches):
            edge = np.zeros(int(block.starts[-1]) + 1, np.int32)
            pairs = []
            for size, (windows, of, names) in wanted.value.items():
                for which, at in block.phrases(windows):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    docs = np.unique(np.searchsorted(block.starts, at, "right") - 1)
                    pairs += [(int(d), names[i]) for i in of[which] for d in docs]
            hit = np.cumsum(edge) > 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
            doc = np.searchsorted(block.starts, change[:, 0], "right") - 1
            own, spans = [[] for _ in ids], [[] for _ in ids]
            for d, item in set(pairs):
                own[d].append(item)
            for d, (a, b) in zip(doc.tolist(), (change - block.starts[doc][:, None]).tolist(), strict=True):
                spans[d] += (a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64()), pa.array(block.sizes), pa.array(spans, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.string()))],
                names=["block", "place", "doc_id", "n_words", "spans", "items"],
            )

    return index.mapInArrow(tidy(run), "block long, place long, doc_id long, n_words long, spans array<long>, items array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, index: DataFrame | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, the spans of hit words (start, end, start, end, ...), items.

    benchmark(item_id, text) is cut into windows of `width` consecutive words; an item of fewer words, but not none, is
    one window. spans may touch where the items took more than one chunk. Null texts have no words; items with a null id
    are left out, rows with one item_id count as one item; null doc_ids stay as they are. Repeated documents each get
    their row, however many chunks the items take. Extra columns are left out.
    """
    index = build_index(docs) if index is None else index
    wanted = benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text").filter("item_id is not null")
    size = wanted.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    chunks = 1 + int(size) // CHUNK_BYTES
    out = None
    for c in range(chunks):
        part = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c) if chunks > 1 else wanted
        found = _search(index, [tuple(r) for r in part.collect()], width)
        out = found if out is None else out.unionByName(found)
    if chunks > 1:
        out = out.groupBy("block", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return out.drop("block", "place")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= min_items) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n, digest = [], [], []
            for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                upto = total = 0
                for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    total += max(0, b - max(a, upto))
                    upto = max(upto, b)
                hits.append(total)
                n.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array([x >= min_items for x in n], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return matches(docs, benchmark, width).mapInArrow(tidy(run), OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_items: int = 2) -> DataFrame:
    """The rows of docs that report() doesn't call contaminated; rows with a null doc_id stay."""
    bad = report(docs, benchmark, width, min_items).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, start, end (word positions, end exclusive) of spans of at most `within` words that hold all terms."""
    wanted = Hashes().of([w for t in terms for w in alnum_words(t.encode())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, block in _blocks(batches):
            spans = block.near(wanted, within)
            doc = np.searchsorted(block.starts, spans[:, 0], "right") - 1
            spans = spans - block.starts[doc][:, None]
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(spans[:, 0]), pa.array(spans[:, 1] + 1)], names=["doc_id", "start", "end"])

    return index.mapInArrow(tidy(run), "doc_id long, start long, end long").dropDuplicates()
