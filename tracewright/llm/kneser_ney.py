"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped.

Counting has two passes. In each a task counts what its texts hold, sorts it, and sends it as packed arrays cut at the
bounds of the buckets, so counts are combined before the shuffle and a word with a third of all tokens is one entry a
task. A bucket's arrays are merged and written to the shared folder as one sorted array.

1. Words: XXH64 and count. Buckets are ranges of the hash; a word's id is its place in the whole sorted array.
2. Bigrams: (id of the first word) * 2**32 + id of the second, and the count, in ranges of equal weight of that number,
   so that a frequent first word is spread over many buckets. From the merged bigrams follow the counts by context (its
   tokens; its followers seen once, twice, and more) and, in a further shuffle, the contexts of each word.

Workers map the files into memory and look up a batch's distinct bigrams, sorted, so that lookups walk the arrays once.
The files grow with the corpus; they are never loaded whole. Order 2 is what the disk limits leave room for.
Buckets are as many as the text asks for, so that one fits a task at any size, and each is a task of its own.

With c counts, D discounts of counts 1, 2 and 3 or more, and V known tokens:
p(w | v) = (c(vw) - D(c(vw))) / c(v) + gamma(v) p1(w), p1(w) = (n(w) - D1(n(w))) / N + gamma1 / (V + 1), where n(w) is the
number of contexts of w and N their sum. Unknown words share one slot. An unknown v backs off to p1.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import as_bytes, keep_until_release, session, shared_dir, tidy
from tracewright.llm.words import Hashes, space_words

#: Tokens counted before a task packs and sends them.
TASK_TOKENS = 6_000_000
#: Bytes of text whose counts make a bucket, and entries that a bucket holds before it sums them up.
BUCKET_BYTES, HELD_ENTRIES = 128 << 20, 4_000_000
#: Stand for the end of a text, for its start as a context, and for words not in the model.
END_WORD = b"\n"
START, UNKNOWN = (1 << 32) - 1, (1 << 32) - 2

PACKED = "bucket int, keys binary, counts binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _local(path: str) -> str:
    """The shared folder as a path that workers can map into memory."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model must be in a folder that workers can map into memory, not {path}")
    return path


def _write(path: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task leaves the same file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _packed(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys cut at bounds: a row for each bucket that has any."""
    at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for b in np.flatnonzero(np.diff(at)):
        own = slice(at[b], at[b + 1])
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([keys[own].tobytes()], pa.binary()), pa.array([counts[own].astype(np.uint32).tobytes()], pa.binary())], names=["bucket", "keys", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of packed rows sorted by bucket: each bucket with its sorted keys and summed counts.

    What is held is summed up whenever it has doubled, so it follows the bucket's distinct keys and not the tasks that
    sent them.
    """
    bucket, keys, counts, held, limit = None, [], [], 0, HELD_ENTRIES
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column("bucket")[i].as_py()
            if bucket is not None and b != bucket:
                yield bucket, *_summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held, limit = [], [], 0, HELD_ENTRIES
            bucket = b
            keys.append(np.frombuffer(batch.column("keys")[i].as_buffer(), np.uint64))
            counts.append(np.frombuffer(batch.column("counts")[i].as_buffer(), np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held > limit:
                one = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [one[0]], [one[1]], len(one[0])
                limit = max(HELD_ENTRIES, 2 * held)
    if bucket is not None:
        yield bucket, *_summed(np.concatenate(keys), np.concatenate(counts))


def _buckets(texts: DataFrame) -> int:
    """Enough for BUCKET_BYTES of text in each, and for the session's tasks."""
    size = texts.selectExpr("coalesce(sum(octet_length(text)), 0) n").first().n
    return max(4, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


class Files:
    """The arrays of a model in the shared folder, mapped into memory."""

    def __init__(self, path: str, meta: str) -> None:
        with open(f"{path}/{meta}.json") as f:
            self.meta = json.load(f)
        self.path, self.word_buckets = path, self.meta["word_buckets"]
        self.first_id = np.array(self.meta["first_id"], np.int64)
        self.mapped: dict[str, np.ndarray] = {}
        self.end = int(self.ids(np.array([Hashes()[END_WORD]], np.uint64))[0])

    def array(self, name: str) -> np.ndarray:
        if name not in self.mapped:
            file = f"{self.path}/{name}.npy"
            self.mapped[name] = np.load(file, mmap_mode="r") if os.path.exists(file) else np.zeros(0, np.int64)
        return self.mapped[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The word ids of hashes; UNKNOWN for those that are not in the model."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        order = np.argsort(hashes)
        at = np.searchsorted(hashes[order], _hash_bounds(self.word_buckets))
        for b, own in enumerate(np.split(order, at)):
            words = self.array(f"word-{b}")
            if len(own) and len(words):
                i = np.minimum(np.searchsorted(words, hashes[own]), len(words) - 1)
                known = words[i] == hashes[own]
                out[own[known]] = self.first_id[b] + i[known]
        return out

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Rows of a per-word array (kept in the buckets of the words) for known, ascending ids."""
        parts = []
        at = np.searchsorted(ids, self.first_id[1:])
        for b, own in enumerate(np.split(ids, at)):
            if len(own):
                parts.append(self.array(f"{name}-{b}")[own - self.first_id[b]])
        return np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending bigram keys."""
        out = np.zeros(len(keys), np.int64)
        bounds = np.array(self.meta["bigram_bounds"], np.uint64)
        at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
        for b in np.flatnonzero(np.diff(at)):
            own = keys[at[b] : at[b + 1]]
            known = self.array(f"bigram-{b}")
            if len(known):
                i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[at[b] : at[b + 1]] = np.where(known[i] == own, self.array(f"bigram-n-{b}")[i], 0)
        return out


@lru_cache(maxsize=2)
def files(path: str, meta: str = "model") -> Files:
    """One per worker process and stage: with meta `words`, before the bigrams are counted."""
    return Files(path, meta)


def _hash_bounds(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


class WordIds(dict):
    """Word to id, for one worker."""

    def __init__(self, model: Files) -> None:
        super().__init__()
        self.model, self.hashes = model, Hashes()

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """Ids of all words of the texts, each text closed by the end's id."""
        if len(self) > 600_000:
            self.clear()
        new = list({w for t in texts for w in t if w not in self})
        if new:
            self.update(zip(new, self.model.ids(self.hashes.of(new)).tolist(), strict=True))
        self[END_WORD] = self.model.end
        return np.fromiter((self[w] for t in texts for w in (*t, END_WORD)), np.int64, sum(map(len, texts)) + len(texts))


def _pairs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bigram keys of running texts: ends are the places of the last tokens."""
    before = np.concatenate([[START], ids[:-1]])
    before[ends[:-1] + 1] = START
    return (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def discounts(n: list[int]) -> list[float]:
    """D for counts 1, 2 and 3 or more, from the numbers of entries with counts 1 to 4 (Chen and Goodman).

    Where they cannot be estimated (few data), 0.5, 1 and 1.5; they are kept within 0 and the count.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if y is not None and a and b else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def fit(docs: DataFrame, path: str | None = None) -> str:
    """Counts docs(text) and writes the model to path (else into the shared folder); returns its path."""
    spark = session(docs)
    if path is None:
        path = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
        keep_until_release(spark, path)
    path = _local(path)
    os.makedirs(path)
    texts = docs.selectExpr("cast(text as string) text")
    buckets = _buckets(texts)
    steps = max(9, min(65, 8192 // buckets))  # what a bucket tells the driver is less where there are many

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes, n = Counter(), Hashes(), 0

        def send() -> Iterator[pa.RecordBatch]:
            yield from _packed(*_summed(hashes.of(list(own)), np.fromiter(own.values(), np.int64, len(own))), _hash_bounds(buckets))

        for batch in batches:
            for text in as_bytes(batch.column("text")):
                found = space_words(text)
                own.update(found)
                own[END_WORD] += 1
                n += len(found) + 1
                if n > TASK_TOKENS:
                    yield from send()
                    own, n = Counter(), 0
        yield from send()

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys, counts in _merged(batches):
            _write(f"{path}/word-{b}.npy", keys)
            _write(f"{path}/count-{b}.npy", counts)
            # Where to cut the bigrams: the tokens' running sum at steps of this bucket's words.
            upto = np.cumsum(counts)
            at = np.unique(np.concatenate([np.searchsorted(upto, np.linspace(0, upto[-1], steps)[1:]), np.argsort(-counts)[:8]]))
            at = at[at < len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(upto[-1])], pa.int64()), pa.array([at.astype(np.int64)], pa.list_(pa.int64())), pa.array([upto[at]], pa.list_(pa.int64()))], names=["bucket", "words", "tokens", "at", "upto"])

    packed = texts.mapInArrow(tidy(words), PACKED).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    found = {r.bucket: r for r in packed.mapInArrow(tidy(keep_words), "bucket int, words long, tokens long, at array<long>, upto array<long>").collect()}  # a row a bucket
    sizes = [found[b].words if b in found else 0 for b in range(buckets)]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if first[-1] >= UNKNOWN:
        raise ValueError("more than 2**32 - 2 distinct words")
    tokens = sum(r.tokens for r in found.values())
    bounds = _bigram_bounds(found, first, tokens, buckets)
    meta = {"word_buckets": buckets, "first_id": first[:-1].tolist(), "vocabulary": int(first[-1]), "tokens": int(tokens), "bigram_bounds": [int(x) for x in bounds]}
    _meta(path, "words", meta)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = WordIds(files(path, "words")), [], 0
        cut = np.array(bounds, np.uint64)

        def send() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            keys, counts = np.unique(keys, return_counts=True)
            yield from _packed(keys, counts, cut)

        for batch in batches:
            own = [space_words(x) for x in as_bytes(batch.column("text"))]
            if not own:
                continue
            held.append(_pairs(ids.of(own), np.cumsum([len(x) + 1 for x in own]) - 1))
            n += len(held[-1])
            if n > TASK_TOKENS:
                yield from send()
                held, n = [], 0
        yield from send()

    def keep_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes each bucket; sends on, by word, its contexts' counts (kind 0) and the words' numbers of contexts (1)."""
        for b, keys, counts in _merged(batches):
            _write(f"{path}/bigram-{b}.npy", keys)
            _write(f"{path}/bigram-n-{b}.npy", counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64))
            of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            context = keys >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)
            yield _stat(context[at], stats, 0, of)
            words, n = np.unique(keys & np.uint64(UNKNOWN + 1), return_counts=True)
            yield _stat(words, np.stack([n, n * 0, n * 0, n * 0], 1), 1, [0] * 4)

    def _stat(ids: np.ndarray, rows: np.ndarray, kind: int, of: list[int]) -> pa.RecordBatch:
        """Rows cut by the words' buckets; the start, which is no word, goes to bucket -1."""
        at = np.concatenate([[0], np.searchsorted(ids, first[1:].astype(np.uint64)), [len(ids)]])
        own = [b for b in np.flatnonzero(np.diff(at))]
        cuts = [slice(at[b], at[b + 1]) for b in own]
        of = [of, *[[0] * 4] * (len(own) - 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([b if b < buckets else -1 for b in own], pa.int32()), pa.array([kind] * len(own), pa.int32()), pa.array([ids[c].tobytes() for c in cuts], pa.binary()), pa.array([rows[c].astype(np.int64).tobytes() for c in cuts], pa.binary()), pa.array(of, pa.list_(pa.int64()))],
            names=["bucket", "kind", "ids", "rows", "of"],
        )

    def keep_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def keep() -> pa.RecordBatch:
            n = sizes[bucket] if bucket >= 0 else 1
            low = int(first[bucket]) if bucket >= 0 else START
            sums = np.zeros((2, n, 4), np.int64)
            for kind, ids, rows in held:
                np.add.at(sums[kind], ids.astype(np.int64) - low, rows)
            if bucket >= 0:
                _write(f"{path}/context-{bucket}.npy", sums[0])
                _write(f"{path}/before-{bucket}.npy", sums[1][:, 0])
            else:
                _write(f"{path}/start.npy", sums[0])
            n = sums[1][:, 0] if bucket >= 0 else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([[*(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n >= 3).sum()), int(n.sum())]], pa.list_(pa.int64())), pa.array([of.tolist()], pa.list_(pa.int64()))], names=["before", "of"])

        of = np.zeros(4, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column("bucket")[i].as_py()
                if bucket is not None and b != bucket:
                    yield keep()
                    held, of = [], np.zeros(4, np.int64)
                bucket = b
                held.append((batch.column("kind")[i].as_py(), np.frombuffer(batch.column("ids")[i].as_buffer(), np.uint64), np.frombuffer(batch.column("rows")[i].as_buffer(), np.int64).reshape(-1, 4)))
                of = of + np.array(batch.column("of")[i].as_py())
        if bucket is not None:
            yield keep()

    counted = texts.mapInArrow(tidy(bigrams), PACKED).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    stats = counted.mapInArrow(tidy(keep_bigrams), "bucket int, kind int, ids binary, rows binary, of array<long>").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    rows = stats.mapInArrow(tidy(keep_stats), "before array<long>, of array<long>").collect()  # a row a bucket
    before = np.sum([r.before for r in rows], 0) if rows else np.zeros(6, np.int64)
    of = np.sum([r.of for r in rows], 0) if rows else np.zeros(4, np.int64)
    meta |= {"d2": discounts([int(x) for x in of]), "d1": discounts([int(x) for x in before[:4]]), "before": [int(x) for x in (before[0], before[1], before[4], before[5])]}
    _meta(path, "model", meta)
    return path


def _bigram_bounds(found: dict, first: np.ndarray, tokens: int, buckets: int) -> list[int]:
    """Bigram keys that cut the tokens, sorted by their first words, in even parts; a frequent word is cut by its second
    words, whose ids are as good as random."""
    knots, total = [(0, 0)], 0
    for b in sorted(found):
        knots += [(int(first[b]) + a + 1, total + u) for a, u in zip(found[b].at, found[b].upto, strict=True)]
        total += found[b].tokens
    ids, upto = np.array([k[0] for k in knots], float), np.array([k[1] for k in knots], float)
    at = np.interp(np.linspace(0, tokens, buckets + 1)[1:-1], upto, ids)
    vocabulary = max(1, int(first[-1]))
    return sorted({(int(x) << 32) + int((x % 1) * vocabulary) for x in at})


def _meta(path: str, name: str, meta: dict) -> None:
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with open(part, "w") as f:
        json.dump(meta, f)
    os.replace(part, f"{path}/{name}.json")


class Scorer:
    """Probabilities of tokens under a model's files."""

    def __init__(self, model: Files) -> None:
        self.model, m = model, model.meta
        self.d1, self.d2 = np.array([0, *m["d1"]]), np.array([0, *m["d2"]])
        one, two, more, self.contexts = m["before"]
        self.v, self.n = m["vocabulary"], m["tokens"]
        left = one * m["d1"][0] + two * m["d1"][1] + more * m["d1"][2]
        self.unseen = (left / self.contexts if self.contexts else 1.0) / (self.v + 1)

    def lower(self, words: np.ndarray) -> np.ndarray:
        """p1 of ascending distinct ids, UNKNOWN last."""
        known = words[words < UNKNOWN]
        n = self.model.by_id("before", known).reshape(-1) if len(known) else np.zeros(0, np.int64)
        p = np.full(len(words), self.unseen)
        p[: len(known)] += np.maximum(n - self.d1[np.minimum(n, 3)], 0) / max(1, self.contexts)
        return p

    def bigram(self, keys: np.ndarray) -> np.ndarray:
        """p of ascending distinct bigram keys."""
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(START)).astype(np.int64)
        words, at = np.unique(word, return_inverse=True)
        lower = self.lower(words)[at]
        contexts, at = np.unique(context, return_inverse=True)
        stats = np.zeros((len(contexts), 4), np.int64)
        known = contexts < UNKNOWN
        stats[known] = self.model.by_id("context", contexts[known])
        start = self.model.array("start")
        if len(start):
            stats[contexts == START] = start
        stats = stats[at]
        total = stats[:, 0]
        n = self.model.bigrams(keys)
        gamma = np.where(total > 0, stats[:, 1:] @ self.d2[1:] / np.maximum(total, 1), 1.0)
        return np.maximum(n - self.d2[np.minimum(n, 3)], 0) / np.maximum(total, 1) + gamma * lower

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of running texts: tokens, known tokens, base score and score of each."""
        starts = np.concatenate([[0], ends[:-1] + 1])
        words, at = np.unique(ids, return_inverse=True)
        known = words[words < UNKNOWN]
        c = np.zeros(len(words))
        c[: len(known)] = self.model.by_id("count", known).reshape(-1)
        base = np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))[at]
        keys, of = np.unique(_pairs(ids, ends), return_inverse=True)
        score = np.log10(self.bigram(keys))[of]
        return ends - starts + 1, np.add.reduceat((ids < UNKNOWN).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)


def score(docs: DataFrame, path: str, held_out: str) -> DataFrame:
    """Scores the rows of docs(doc_id, text) with the model at path; held_out is a condition on docs."""
    session(docs)
    path = _local(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = files(path)
        scorer, ids = Scorer(model), WordIds(model)
        for batch in batches:
            own = [space_words(x) for x in as_bytes(batch.column("text"))]
            if not own:
                continue
            n, known, base, total = scorer.texts(ids.of(own), np.cumsum([len(x) + 1 for x in own]) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(own), scorer.n), pa.int64()), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", f"coalesce({held_out}, true) held_out", "cast(text as string) text").mapInArrow(tidy(run), OUT)


def score_corpus(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1") -> DataFrame:
    """Learns from the rows of docs(doc_id, text) that are not held out, and scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10, base: add-half unigrams).
    Null texts are empty: one token, the end. A null doc_id is held out. Repeated rows count as often as they occur and
    each get their row; extra columns are left out. Without training rows all tokens are unknown.
    """
    path = fit(docs.filter(f"not coalesce({held_out}, true)"))
    return score(docs, path, held_out)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of held-out and training texts, by the model and by the base."""
    return scored.groupBy("held_out").agg({"n_tokens": "sum", "score": "sum", "base_score": "sum"}).selectExpr("held_out", "`sum(n_tokens)` tokens", "power(10, -`sum(score)` / `sum(n_tokens)`) perplexity", "power(10, -`sum(base_score)` / `sum(n_tokens)`) base_perplexity")
