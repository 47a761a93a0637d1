"""Edit-aware token counting.

Each document keeps a segment tree whose leaves are its pre-tokens (matches of the tokenizer's pattern) with their token
counts; inner nodes hold sums. build_trees() makes a table of them, which can be written and edited as often as wanted.
An edit replaces a range of characters. Only the pre-tokens it touches are split and encoded again, together with
boundary context: two pre-tokens to the left, since a match can look one character ahead, and to the right as far as it
takes until the new matches end where an old one ended. From there on the old matches hold, as a match depends only on
what follows its start. The changed leaves are set and the sums above them updated, in O(log n) each.

apply_edits() takes the edits as a table, or as a function of the text, and returns the table of the edited documents'
trees: the leaves of a touched region give way to those of its new pre-tokens, the others are taken over as they are.

Building, and edits by a function, are narrow maps over the rows: no shuffle, one batch of documents in memory. A table
of edits is gathered by document (its edits fit where the document does) and joined to the trees.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.bpe import CACHED_CHARS, CACHED_PIECES, parse_ranks, read_rank_file
from tracewright.llm.common import as_text, session, tidy

#: ends: character ends of the pre-tokens; nodes: the segment tree; both of little-endian unsigned 32-bit integers.
TREE = "doc_id long, text string, ends binary, nodes binary"
COUNT_COLUMNS = "n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, n_chars_after long"
EDITS = "array<struct<start: int, end: int, new: string>>"

#: What the default edits mask: e-mail addresses, and runs of five and more digits.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]{5,}")

Edit = tuple[int, int, str]


def mask_private(text: str) -> list[Edit]:
    """The default edits: masks for e-mail addresses and for long numbers outside them."""
    mails, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            mails.append((start, last, "<mail>"))
        at = text.find("@", max(at + 1, last))
    numbers = [(m.start(), m.end(), "<number>") for m in NUMBER.finditer(text)]
    if not mails:
        return numbers
    starts = [m[0] for m in mails]
    apart = [x for x in numbers if not (i := bisect_right(starts, x[1] - 1)) or mails[i - 1][1] <= x[0]]
    return sorted(mails + apart)


class SumTree:
    """Sums over leaves, with point updates. The n leaves are nodes n to 2n - 1, node i is the sum of 2i and 2i + 1."""

    def __init__(self, node: np.ndarray) -> None:
        self.node = node

    @classmethod
    def of(cls, leaves: np.ndarray) -> SumTree:
        n = len(leaves)
        node = np.zeros(2 * n, np.int64)
        node[n:] = leaves
        high = n
        while high > 1:  # the children of nodes low to high - 1 are at high and beyond
            low = (high + 1) // 2
            node[low:high] = node[2 * low : 2 * high : 2] + node[2 * low + 1 : 2 * high : 2]
            high = low
        return cls(node)

    def leaves(self) -> np.ndarray:
        return self.node[len(self.node) // 2 :]

    def total(self) -> int:
        return int(self.node[1]) if len(self.node) else 0

    def put(self, leaf: int, value: int) -> None:
        i = len(self.node) // 2 + leaf
        change = int(value - self.node[i])
        while change and i:
            self.node[i] += change
            i >>= 1


class Counts(dict):
    """Piece to its number of tokens; misses are encoded by the tokenizer's library, and kept if short.

    When full, the older half of the pieces goes.
    """

    def __init__(self, raw: bytes, pattern: str) -> None:
        super().__init__()
        self.split = regex.compile(pattern)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.library.encode_ordinary(piece))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(raw: bytes, pattern: str) -> Counts:
    """One per worker process, whose pieces live on between tasks."""
    return Counts(raw, pattern)


class CountedText:
    """A text with its pre-tokens' ends and the tree of their counts."""

    def __init__(self, text: str, ends: list[int], tree: SumTree) -> None:
        self.text, self.ends, self.tree = text, ends, tree
        #: By edit(): first leaf, leaf behind the last, and the lengths and counts of the pre-tokens instead.
        self.regions: list[tuple[int, int, list[int], list[int]]] = []

    @classmethod
    def of(cls, text: str, own: Counts) -> CountedText:
        pieces = own.split.findall(text)
        return cls(text, list(accumulate(map(len, pieces))), SumTree.of(np.fromiter(map(own.__getitem__, pieces), np.int64, len(pieces))))

    @classmethod
    def stored(cls, text: str, ends: bytes, nodes: bytes) -> CountedText:
        return cls(text, np.frombuffer(ends, "<u4").tolist(), SumTree(np.frombuffer(nodes, "<u4").astype(np.int64)))

    def row(self) -> tuple[str, bytes, bytes]:
        return self.text, np.array(self.ends, "<u4").tobytes(), self.tree.node.astype("<u4").tobytes()

    def n_reencoded(self) -> int:
        return sum(len(lengths) for _, _, lengths, _ in self.regions)

    def _first(self, start: int) -> int:
        """The leaf from which to encode again for an edit at start."""
        return min(max(0, bisect_right(self.ends, max(0, start - 1)) - 2), len(self.ends) - 1)

    def edit(self, edits: list[Edit], own: Counts) -> str:
        """Applies edits of the text, in order and without overlap, to the tree; returns the new text.

        Edits whose regions meet are handled as one region. A region's first leaf takes its sum, the others 0, until
        edited() gives each new pre-token a leaf; so this is called once, and then on what edited() returns.
        """
        text, ends, n = self.text, self.ends, len(self.ends)
        parts, offsets, at, shift = [], [], 0, 0
        for start, end, new in edits:
            if start < at or end < start or end > len(text):
                raise ValueError(f"edit {start}:{end} overlaps another or leaves the text")
            parts += [text[at:start], new]
            shift += len(new) - (end - start)
            offsets.append(shift)
            at = end
        parts.append(text[at:])
        changed = "".join(parts)
        if not n:
            pieces = own.split.findall(changed)
            self.regions = [(0, 0, list(map(len, pieces)), list(map(own.__getitem__, pieces)))]
            self.tree = SumTree.of(np.array([sum(self.regions[0][3])]))
            return changed
        k = 0
        while k < len(edits):
            first = self._first(edits[k][0])
            pos = (ends[first - 1] if first else 0) + (offsets[k - 1] if k else 0)
            lengths, counts, last = [], [], n
            while pos < len(changed):
                m = own.split.match(changed, pos)
                lengths.append(m.end() - pos)
                counts.append(own[m[0]])
                pos = m.end()
                while k + 1 < len(edits) and edits[k + 1][0] + offsets[k] < pos:
                    k += 1
                # Over where a match ends at an old boundary beyond the region's last edit, with a leaf of its own.
                old = pos - offsets[k]
                i = bisect_right(ends, old)
                if old >= edits[k][1] and i > first and ends[i - 1] == old:
                    if k + 1 == len(edits) or self._first(edits[k + 1][0]) >= i:
                        last = i
                        break
                    k += 1
            else:
                k = len(edits) - 1
            for leaf in range(first + 1, last):
                self.tree.put(leaf, 0)
            self.tree.put(first, sum(counts))
            self.regions.append((first, last, lengths, counts))
            k += 1
        return changed

    def edited(self, changed: str) -> CountedText:
        """The new text, as edit() returned it, with a leaf for each of its pre-tokens: none is encoded again."""
        if not self.regions:
            return self
        old_lengths, old_counts = np.diff(self.ends, prepend=0).astype(np.int64), self.tree.leaves()[: len(self.ends)]
        lengths, counts, at = [], [], 0
        for first, last, new_lengths, new_counts in self.regions:
            lengths += [old_lengths[at:first], np.array(new_lengths, np.int64)]
            counts += [old_counts[at:first], np.array(new_counts, np.int64)]
            at = last
        ends = np.cumsum(np.concatenate([*lengths, old_lengths[at:]]))
        return CountedText(changed, ends.tolist(), SumTree.of(np.concatenate([*counts, old_counts[at:]])))


def _shared_ranks(df: DataFrame, rank_file: str):
    return session(df).sparkContext.broadcast(read_rank_file(rank_file))  # of a size that read_rank_file checks


def build_trees(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of df(doc_id, text): doc_id, text, ends and nodes, its pre-tokens' ends and segment tree.

    Null texts are empty; empty texts have no leaf; extra columns are left out; repeated rows each get their row.
    """
    raw = _shared_ranks(df, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(raw.value, pattern)
        for batch in batches:
            rows = [CountedText.of(text, own).row() for text in as_text(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_tree_columns(rows)], names=["doc_id", "text", "ends", "nodes"])

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(run), TREE)


def _tree_columns(rows: list[tuple[str, bytes, bytes]]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))]


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with a column `edits`: those of the document in edits(doc_id, start, end, new), in order.

    start and end are characters of the text as it is in trees; a null `new` deletes. Edits without a doc_id, start or
    end are left out, as are those of documents that trees lacks; rows of one doc_id all get its edits. Rows with a null
    doc_id have none and stay out of the join.
    """
    own = edits.filter("doc_id is not null and start is not null and end is not null").selectExpr("cast(doc_id as long) doc_id", "struct(cast(start as int) start, cast(end as int) end, coalesce(cast(new as string), '') new) edit")
    own = own.groupBy("doc_id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    joined = trees.filter("doc_id is not null").join(own, "doc_id", "left")
    return joined.unionByName(trees.filter("doc_id is null").withColumn("edits", F.lit(None).cast(EDITS)))


def apply_edits(trees: DataFrame, rank_file: str, pattern: str, edits: Callable[[str], list[Edit]] | DataFrame = mask_private, keep_trees: bool = True) -> DataFrame:
    """The rows of trees (see build_trees) after their edits, counted from the touched regions.

    edits is a table (see with_edits) or a function of the text. Returns doc_id, text, ends and nodes of the new texts,
    to be edited again, unless keep_trees is false, and n_pretokens, n_tokens (before), n_edits, n_reencoded (pre-tokens
    encoded), n_tokens_after, n_chars_after. Edits that overlap or leave the text are an error.
    """
    raw = _shared_ranks(trees, rank_file)
    given = isinstance(edits, DataFrame)
    asked, ask = (with_edits(trees, edits), None) if given else (trees, edits)
    names = [x.split()[0] for x in COUNT_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(raw.value, pattern)
        for batch in batches:
            rows, after = [], []
            ends, nodes = (batch.column(c).to_pylist() for c in ("ends", "nodes"))
            listed = batch.column("edits").to_pylist() if ask is None else None
            for i, text in enumerate(as_text(batch.column("text"))):
                counted = CountedText.stored(text, ends[i], nodes[i])
                wanted = [(e["start"], e["end"], e["new"]) for e in listed[i] or ()] if ask is None else ask(text)
                before = len(counted.ends), counted.tree.total()
                new = counted.edit(wanted, own) if wanted else text
                rows.append((*before, len(wanted), counted.n_reencoded(), counted.tree.total(), len(new)))
                if keep_trees:
                    after.append(counted.edited(new).row())
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            kept = dict(zip(("text", "ends", "nodes"), _tree_columns(after), strict=True)) if keep_trees else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept.values(), *columns], names=["doc_id", *kept, *names])

    columns = ["doc_id", "text", "ends", "nodes", *(["edits"] if given else [])]
    return asked.select(*columns).mapInArrow(tidy(run), f"{TREE if keep_trees else 'doc_id long'}, {COUNT_COLUMNS}")


def count_with_edits(df: DataFrame, rank_file: str, pattern: str, edits: Callable[[str], list[Edit]] | DataFrame = mask_private) -> DataFrame:
    """Per row of df(doc_id, text): doc_id and the counts that apply_edits() gives for its tree.

    Null and empty texts count 0 tokens; extra columns are left out; repeated rows each get their row.
    """
    return apply_edits(build_trees(df, rank_file, pattern), rank_file, pattern, edits, keep_trees=False)
