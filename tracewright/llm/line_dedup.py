"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words (edits are of whole words, so a typo is one edit). A line's variants are the
line itself and, for each of its words, the line without it, as hashed keys. Two lines are one edit apart if

- they lose the word at the same place and are equal then (substitution), or
- one is equal to the other without one word (insertion, deletion).

A line is removed if an earlier line of the corpus is equal or within the bound, whether or not that one is removed
itself; earlier is by doc_id, then, of different texts under one doc_id, by the text's hash, then by place in the
document; of exact repeats (doc_id and text) all but one count as later. So of each group of equal variants only the earliest line
matters: it is the witness for all others. A task settles its own groups and sends one entry a group, so a group of any
size costs one entry a task, and no pairs are made.

Exact copies are folded first. Then lines that cannot have a neighbour are dropped from the join by a sound filter: two
lines within one edit have at least half of the shorter one's words in common at the start or at the end, so a line
whose start and end of that length (on a coarse grid of lengths) occur in no other distinct line is alone.

What is left is sorted by place, and its variants go through the shuffle as packed arrays: hash, place of the lost word,
number of the line. Before a line goes, its words and its witness's are compared (edit distance), so a collision of
hashes keeps a line rather than losing one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, as_bytes, session, stored, tidy
from tracewright.llm.words import Hashes, space_words

#: Lines of fewer words only match exactly: one edit in five words leaves a similarity of 0.8. The bound stays at one edit
#: in longer lines.
MIN_WORDS = 5
#: Base of the rolling hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
#: The columns that name a row up to exact repeats, and the second of them.
KEY, TEXT_HASH = ("doc_id", "text_hash"), "xxhash64(cast(text as string))"
GRID = sorted({int(2 * 1.25**k) for k in range(1, 80)})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of rolling hashes, whose low bits are weak."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lines:
    """Word hashes of many lines in a row, with prefix sums: the hash of any part of a line in two steps.

    starts has one entry more than there are lines; every line has words.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray) -> None:
        self.words, self.starts = words, starts
        self.first, self.last = starts[:-1], starts[1:]
        self.up, self.down = _powers(len(words) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.up[: len(words)])])

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def whole(self) -> np.ndarray:
        return self.part(self.first, self.last)

    def without_each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: the hash of its line without it, its line, and its place there."""
        n = self.last - self.first
        line = np.repeat(np.arange(len(n)), n)
        a, b, i = self.first[line], self.last[line], np.arange(len(self.words))
        rest = self.sums[i] - self.sums[a] + (self.sums[b] - self.sums[i + 1]) * self.down[1]
        return _mix(rest * self.down[a] + (n[line] - 1).astype(np.uint64)), line, i - a

    def halves(self) -> list[np.ndarray]:
        """For each line the hashes of its starts and ends of the lengths in half_sizes()."""
        n = self.last - self.first
        low, high = HALF[np.minimum(n, len(HALF) - 1)], HALF[np.minimum(n + 1, len(HALF) - 1)]
        out = []
        for g in (low, high):
            size = np.minimum(g, n)
            for h, sign in ((self.part(self.first, self.first + size), 1), (self.part(self.last - size, self.last), 2)):
                out.append(_mix(h + (size * 4 + sign).astype(np.uint64)))
        return out


def _half_table(longest: int) -> np.ndarray:
    """The largest grid length within half of each line length."""
    n = np.arange(longest + 1) // 2
    return np.array(GRID)[np.maximum(np.searchsorted(GRID, np.maximum(n, GRID[0]), "right") - 1, 0)]


#: Lines beyond this many words are filtered by the half of this many.
HALF = _half_table(1 << 16)


def half_sizes(n: int) -> set[int]:
    """Lengths at which a line of n words shows its start and end: one is in common with lines of n - 1 to n + 1 words."""
    return {int(HALF[min(m, len(HALF) - 1)]) for m in (n, n + 1)}


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line with words: key (hash of the words), doc_id, text_hash, line, whether it is the first one of
    its row, n words, and the hashes of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(1)
        for batch in batches:
            words, sizes, docs_of, hashes_of, numbers, heads = [], [], [], [], [], []
            for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in KEY), as_bytes(batch.column("text")), strict=True):
                head = True
                for number, line in enumerate(text.translate(LOWER).split(b"\n")):
                    own = line.split()
                    if own:
                        words += own
                        sizes.append(len(own))
                        docs_of.append(doc)
                        hashes_of.append(text_hash)
                        numbers.append(number)
                        heads.append(head)
                        head = False
            n = np.array(sizes, np.int64)
            lines = Lines(hashes.of(words), np.concatenate([[0], np.cumsum(n)]))
            halves = np.stack(lines.halves(), 1).view(np.int64) if len(n) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lines.whole().view(np.int64)),
                    pa.array(docs_of, pa.int64()),
                    pa.array(hashes_of, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(heads, pa.bool_()),
                    pa.array(n.astype(np.int32)),
                    *(pa.array(halves[:, i]) for i in range(4)),
                ],
                names=["key", *KEY, "line", "head", "n", "a", "b", "c", "d"],
            )

    return docs.mapInArrow(tidy(run), "key long, doc_id long, text_hash long, line int, head boolean, n int, a long, b long, c long, d long")


def _removals(docs: DataFrame, fuzzy: bool) -> tuple[DataFrame, bool]:
    """doc_id, text_hash, line, again: what goes; and whether there are exact repeats. docs(doc_id, text_hash, text) has
    no nulls. Where again is true, the line goes from all rows of that doc_id and text but one, else from that one."""
    seen = stored(_occurrences(docs))
    repeats = stored(seen.filter("head").groupBy(*KEY).agg(F.count("*").alias("c")).filter("c > 1").select(*KEY))
    repeated = not repeats.isEmpty()
    at = F.struct(*KEY, "line")
    # One row for each distinct line, with its earliest place.
    distinct = stored(seen.groupBy("key").agg(F.min(F.struct(*KEY, "line", "n", "a", "b", "c", "d")).alias("x"), F.count("*").alias("copies")).select("key", "copies", "x.*"))
    goes = distinct.filter("copies > 1").select("key", at.alias("first"))
    if fuzzy:
        keyed = distinct.filter(F.col("n") >= MIN_WORDS - 1).select("key", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("half"))
        shared = keyed.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
        candidates = keyed.join(shared, "half").select("key").distinct()
        wanted = _lines_of(docs, distinct.join(candidates, "key").select("key", *KEY, "line"), repeated)
        edited = _verified(wanted, _witnessed(wanted)).withColumn("first", F.lit(None).cast("struct<doc_id:long,text_hash:long,line:int>"))
        goes = edited.unionByName(goes.join(edited.select("key"), "key", "left_anti"))
    # Later copies of a line go, and all copies of a line with an earlier neighbour.
    out = seen.select("key", *KEY, "line").join(goes, "key").filter(F.col("first").isNull() | (at > F.col("first"))).select(*KEY, "line", F.lit(False).alias("again"))
    if repeated:
        out = out.unionByName(seen.join(repeats, list(KEY), "left_semi").select(*KEY, "line", F.lit(True).alias("again")))
    return out, repeated


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text of docs. The first two name a row up to exact repeats."""
    return docs.selectExpr("cast(doc_id as long) doc_id", f"{TEXT_HASH} text_hash", "cast(text as string) text")


def _gone(removals: DataFrame) -> DataFrame:
    """_doc, _hash, _gone (lines that go from one row of that text) and _again (from the others; null if there are none)."""
    lines = lambda x: F.array_sort(F.collect_set(F.when(x, F.col("line"))))
    again = lines(F.col("again"))
    return removals.groupBy(*KEY).agg(lines(~F.col("again")).alias("_gone"), F.when(F.size(again) > 0, again).alias("_again")).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})


def _lines_of(docs: DataFrame, places: DataFrame, repeated: bool) -> DataFrame:
    """part, number, key and text of the lines at places(key, doc_id, text_hash, line); (part, number) is their order in
    the corpus. If docs has exact repeats, each line is still read once."""
    spark = docs.sparkSession
    asked = places.groupBy(*KEY).agg(F.collect_list(F.struct("line", "key")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text, own in zip(*(batch.column(c).to_pylist() for c in KEY), as_bytes(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                lines = text.split(b"\n")
                rows += [(doc, text_hash, x["line"], x["key"], lines[x["line"]]) for x in own]
            c = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(c, kinds, strict=True)], names=[*KEY, "line", "key", "text"])

    found = docs.join(asked, list(KEY)).mapInArrow(tidy(run), "doc_id long, text_hash long, line int, key long, text binary")
    found = stored(found.dropDuplicates(["key"]) if repeated else found)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(n, *KEY, "line").sortWithinPartitions(*KEY, "line").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            own = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("part"), own, batch.column("key"), batch.column("text")], names=["part", "number", "key", "text"])

    return stored(ordered.mapInArrow(tidy(number), "part int, number long, key long, text binary"))


def _settle(h: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of variants (place WHOLE: the line itself): pairs of a line and an earlier one of its group, and which variants
    are the earliest of their hash and place."""
    if not len(h):
        return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    order = np.lexsort((rank, place, h))
    h, place, rank = h[order], place[order], rank[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    least = np.repeat(rank[first], np.diff(np.append(first, len(h))))
    later = rank > least
    pairs = [(rank[later], least[later])]
    # The whole line of a hash (its last place) and the earliest of those that became it.
    of_h = np.flatnonzero(new_h)
    size = np.diff(np.append(of_h, len(h)))
    lost = np.where(place == WHOLE, NONE, rank)
    whole = np.where(place == WHOLE, rank, NONE)
    lost, whole_of = np.repeat(np.minimum.reduceat(lost, of_h), size), np.repeat(np.minimum.reduceat(whole, of_h), size)
    x = (place == WHOLE) & (lost < rank)
    pairs.append((rank[x], lost[x]))
    x = (place != WHOLE) & (whole_of < rank)
    pairs.append((rank[x], whole_of[x]))
    return np.stack([np.concatenate(c) for c in zip(*pairs, strict=True)]), order[new]


#: The place of a variant that is the line itself: lines have fewer words.
WHOLE, NONE = (1 << 32) - 1, np.iinfo(np.int64).max
#: Variants that a task settles at once; lines are numbered within parts by this many bits.
AT_ONCE, NUMBER_BITS = 1_000_000, 40


def _witnessed(wanted: DataFrame) -> DataFrame:
    """late and early: lines (part and number in one) and an earlier line with an equal variant."""
    spark = wanted.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    schema = "bucket int, h binary, place binary, rank binary, pairs binary"

    def packed(bucket: int, h: np.ndarray, place: np.ndarray, rank: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h, place.astype(np.uint32), rank, pairs))], names=["bucket", "h", "place", "rank", "pairs"])

    def unique(pairs: np.ndarray) -> np.ndarray:
        """One witness, the earliest, for each line."""
        o = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, o]
        return pairs[:, np.concatenate([[True], pairs[0][1:] != pairs[0][:-1]])[: pairs.shape[1]]]

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(1), [], 0

        def send() -> Iterator[pa.RecordBatch]:
            h, place, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            pairs, kept = _settle(h, place, rank)
            h, place, rank = h[kept], place[kept], rank[kept]
            none = np.zeros((2, 0), np.int64)
            yield packed(int(h[0] % np.uint64(buckets)), h[:0], place[:0], rank[:0], unique(pairs))
            at = np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])
            for b in np.flatnonzero(np.diff(at)):
                own = slice(at[b], at[b + 1])
                yield packed(int(b), h[own], place[own], rank[own], none)

        for batch in batches:
            texts = [space_words(x) for x in as_bytes(batch.column("text"))]
            if not texts:
                continue
            rank = batch.column("part").to_numpy().astype(np.int64) << NUMBER_BITS | batch.column("number").to_numpy()
            size = np.array([len(x) for x in texts])
            lines = Lines(hashes.of([w for x in texts for w in x]), np.concatenate([[0], np.cumsum(size)]))
            h, line, place = lines.without_each()
            long_enough = size[line] >= MIN_WORDS
            held.append((np.concatenate([lines.whole(), h[long_enough]]), np.concatenate([np.full(len(size), WHOLE), place[long_enough]]), np.concatenate([rank, rank[line[long_enough]]])))
            n += len(held[-1][0])
            if n > AT_ONCE:
                yield from send()
                held, n = [], 0
        if held:
            yield from send()

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def out() -> pa.RecordBatch:
            h, place, rank, pairs = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            found = unique(np.concatenate([pairs, _settle(h, place.astype(np.int64), rank)[0]], axis=1))
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["late", "early"])

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column("bucket")[i].as_py()
                if bucket is not None and b != bucket:
                    yield out()
                    held = []
                bucket = b
                h, place, rank, pairs = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("h", np.uint64), ("place", np.uint32), ("rank", np.int64), ("pairs", np.int64)))
                held.append((h, place, rank, pairs.reshape(2, -1)))
        if held:
            yield out()

    dealt = wanted.mapInArrow(tidy(variants), schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(settled), "late long, early long").groupBy("late").agg(F.min("early").alias("early"))


def _verified(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """key of the late lines that are at most one edit of a word away from their early ones."""
    own = wanted.select((F.shiftleft(F.col("part").cast("long"), NUMBER_BITS).bitwiseOR(F.col("number"))).alias("rank"), "key", "text")
    late = own.select(F.col("rank").alias("late"), "key", F.col("text").alias("x"))
    early = own.select(F.col("rank").alias("early"), F.col("text").alias("y"))
    both = pairs.join(late, "late").join(early, "early").select("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within_one_edit(space_words(x), space_words(y)) for x, y in zip(as_bytes(batch.column("x")), as_bytes(batch.column("y")), strict=True)]
            yield batch.select(["key"]).filter(pa.array(near, pa.bool_()))

    return stored(both.mapInArrow(tidy(run), "key long"))


def within_one_edit(a: list, b: list) -> bool:
    """Whether two sequences are equal or one substitution, insertion or deletion apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def dedup(docs: DataFrame, fuzzy: bool = True, keep: str = "nonempty") -> DataFrame:
    """docs with duplicate lines removed from text, and the long columns n_lines and n_removed.

    A line (what newlines separate) goes if an earlier line, by (doc_id, hash of the text, place), has the same words or, from MIN_WORDS
    words on in one of the two, is one edit of a word away. Words are as in [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Lines
    without words stay. With keep="nonempty", documents that lose all their lines with words go; with keep="all" they
    stay, with what is left. Null texts and documents without words stay as they are. Of exact
    repeats (doc_id and text) any one is the earliest. Rows with a null doc_id stay as they are, and take no part. Other columns stay; ones named n_lines or n_removed are replaced.
    """
    session(docs)
    removals, repeated = _removals(_keyed(docs).filter("doc_id is not null and text is not null"), fuzzy)
    gone = _gone(stored(removals))
    kept = docs.drop("n_lines", "n_removed")
    out = kept.join(gone, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.expr(TEXT_HASH) == F.col("_hash")), "left")
    if repeated:
        later = out.filter("_again is not null").withColumn("_copy", F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy("_hash")))
        later = later.withColumn("_gone", F.when(F.col("_copy") > 1, F.col("_again")).otherwise(F.col("_gone"))).drop("_copy")
        out = out.filter("_again is null").unionByName(later)
    out = out.withColumn("_gone", F.when(F.size("_gone") > 0, F.col("_gone")))
    lines = F.split("text", "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains("_gone", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    out = out.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if keep == "nonempty":
        out = out.filter(F.col("_gone").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col("_left").alias("text") if c == "text" else F.col(c) for c in kept.columns), "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (the numbers from 0 of the lines that go, ascending) for each document.

    Without the texts, which dedup() returns: they need not go through a shuffle for this. Null texts have no lines, rows
    with a null doc_id lose none, exact repeats each get a row (all but one lose what an earlier copy has), and texts
    under one doc_id are told apart by their hash. Tables may be smaller than the number of partitions, or empty.
    """
    session(docs)
    own = _keyed(docs)
    gone = _gone(_removals(own.filter("doc_id is not null and text is not null"), True)[0])
    # Exact repeats are folded: which of them is the earliest does not show.
    lines = own.groupBy(*KEY).agg(F.max(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")).alias("n_lines"), F.count("*").cast("int").alias("c"))
    out = lines.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c"))))
    out = out.withColumn("removed", F.coalesce(F.when(F.col("copy") > 1, F.col("_again")).otherwise(F.col("_gone")), F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
