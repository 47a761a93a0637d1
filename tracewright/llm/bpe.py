"""Byte-level BPE encoding and decoding.

A piece (one match of the pre-token pattern) is merged with a segment tree over its byte positions. A leaf holds the
rank of the pair that starts there, the root the lowest rank and, among equal ranks, the leftmost position. Each merge
takes the root's pair and makes three point updates: at the merged token, at the token it swallowed, and at its live
left neighbour. So a piece of n bytes costs O(n log n), also where a document is one unbroken run of letters.

Encoding is a narrow map over the rows: no shuffle, and memory is one batch of texts and a bounded cache of pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm.common import as_text, session, tidy

#: Bound of the rank file that is broadcast.
MAX_RANK_FILE = 64 << 20
#: Pieces kept per worker, and the longest that is kept.
CACHED_PIECES, CACHED_CHARS = 250_000, 128

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_rank_file(path: str) -> bytes:
    """The raw rank file; its size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Merger:
    """Merges the bytes of a piece by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def ids(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 0:
            return []
        get, none = ranks.get, 1 << 62
        width = 1 << (n - 1).bit_length()
        # Leaf i is at width + i: the rank of the pair that starts at byte i, times width, plus i.
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))
        mask = width - 1
        while (low := tree[1]) != none:
            i = low & mask
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            for leaf in (j, i, h) if h >= 0 else (j, i):
                value = none
                if leaf != j and (end := after[leaf]) < n:
                    rank = get(piece[leaf : after[end]])
                    if rank is not None:
                        value = rank * width + leaf
                node = width + leaf
                while tree[node] != value:
                    tree[node] = value
                    node >>= 1
                    if not node:
                        break
                    a, b = tree[2 * node], tree[2 * node + 1]
                    value = a if a < b else b
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


class Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers; misses are encoded, and kept if short.

    When full, the older half of the pieces goes; those that come up again move to the newer half.
    """

    def __init__(self, merger: Merger) -> None:
        super().__init__()
        self.merger, self.older = merger, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.merger.ids(piece.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = regex.compile(pattern)
        self.pieces = Pieces(Merger(ranks))
        self.token: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    """One codec per worker process, whose cache of pieces lives on between tasks."""
    return Codec(parse_ranks(raw), pattern)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """df with the array column ids: the token ids of text.

    Null and empty texts have no ids; df's other columns stay, but for one named ids, which is replaced. Repeated rows
    each get their row.
    """
    spark = session(df)
    raw = spark.sparkContext.broadcast(read_rank_file(rank_file))
    kept = df.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for batch in batches:
            ids = [np.frombuffer(own.encode(x), "<i4") for x in as_text(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """df with the binary column decoded: the bytes that the token ids stand for (null: empty)."""
    spark = session(df)
    raw = spark.sparkContext.broadcast(read_rank_file(rank_file))
    kept = df.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, "")
        for batch in batches:
            out = [b"".join(own.token[x] for x in row or ()) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(tidy(run), schema)


def digests(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of df(doc_id, text): doc_id, n_tokens, and the digests of its ids and of the bytes decoded from them."""
    spark = session(df)
    raw = spark.sparkContext.broadcast(read_rank_file(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in as_text(batch.column("text")):
                ids = own.encode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(run), OUT)
