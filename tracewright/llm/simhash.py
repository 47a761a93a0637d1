"""SimHash near-duplicates with BK-trees.

A fingerprint takes the majority of each bit over the hashes of a text's word shingles. Distinct fingerprints go to
shards: of PARTS parts of the 64 bits, two fingerprints within R bits agree on at least PARTS - R, so each goes to one
shard for every choice of that many parts and its bits there. With five parts and R = 3 that is ten shards of 25 to 26
bits; every linked pair meets in one. Shards of one fingerprint are dropped after a count.

In a shard a BK-tree is grown: children are keyed by their Hamming distance to the parent, and a search follows only
edges within R of the distance to the node. Each fingerprint is searched for, joined with all it finds in the shard's
union-find, and inserted. A shard returns one link to the local root for each fingerprint, not pairs. Shard trees are
not broadcast, as all of them together grow with the corpus: the fingerprints are dealt out to their trees instead.
A shard of more than SHARD_ROWS is dealt out again in the same way by the bits that its fingerprints don't share: ten
smaller shards each. As fingerprints are distinct, none of those has more than 2**17, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import as_bytes, cut, session, tidy
from tracewright.llm.components import components
from tracewright.llm.words import space_words

SHINGLE, SEED, RADIUS, PARTS, SHARD_ROWS = 3, 42, 3, 5, 2000
#: With the doc_id, it names a row up to exact repeats.
TEXT_HASH = "xxhash64(cast(text as string))"


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; of no words, zero."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    span = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a : b - 1], seed) for a, b in zip(ends[:n], ends[span:], strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        total += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


class Tree:
    """A BK-tree of 64-bit fingerprints."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        values, at = self.values, 0
        values.append(value)
        self.children.append({})
        new = len(values) - 1
        while new:
            d = (values[at] ^ value).bit_count()
            to = self.children[at].get(d)
            if to is None:
                self.children[at][d] = new
                return
            at = to

    def search(self, value: int, radius: int) -> list[int]:
        """The indexes of values within radius."""
        values, children, found = self.values, self.children, []
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            own = children[at]
            if len(own) <= 2 * radius + 1:
                todo += [to for edge, to in own.items() if d - radius <= edge <= d + radius]
            else:
                todo += [own[edge] for edge in range(d - radius, d + radius + 1) if edge in own]
        return found


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A link to its local root for each value that has any within radius."""
    tree, root = Tree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.search(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.insert(value)
    return [(v, values[top(i)]) for i, v in enumerate(values) if top(i) != i]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and h (hash of the text) for each row of docs(doc_id, text);
    null text: no words."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("h")], names=["doc_id", "fp", "h"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", f"{TEXT_HASH} h").mapInArrow(tidy(run), "doc_id long, fp long, h long")


def _agreed(bits: list[int], radius: int, parts: int) -> list[int]:
    """Masks, as signed longs, of which two values within radius agree on one at least: of the bits cut in parts, every
    choice of all but radius parts."""
    edges = np.linspace(0, len(bits), parts + 1).astype(int)
    of = [sum(1 << b for b in bits[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(of, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """u and v: links that connect the same distinct fps(fp) as all pairs within radius do."""
    masks = _agreed(list(range(64)), radius, parts)
    shards = F.array(*(F.struct(F.lit(i).cast("byte").alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(shards).alias("s")).select("fp", "s.i", "s.bits")
    counts = keyed.groupBy("i", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    # A crowded shard's free bits are cut in parts again; of the others the only part is all of them.
    finer = F.array(*(F.array(*(F.lit(x) for x in _agreed([b for b in range(64) if not m >> b & 1], radius, parts))) for m in masks))
    again = F.when(F.col("n") > shard_rows, F.transform(F.get(finer, F.col("i").cast("int")), lambda m, j: F.struct(j.alias("j"), F.col("fp").bitwiseAND(m).alias("own")))).otherwise(F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("own"))))
    dealt = keyed.join(counts, ["i", "bits"]).select("fp", "i", "bits", F.explode(again).alias("x")).select("fp", "i", "bits", "x.j", "x.own")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "i", "bits", "j", "own").sortWithinPartitions("i", "bits", "j", "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values = None, []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64).tolist()
            names = zip(*(batch.column(c).to_pylist() for c in ("i", "bits", "j", "own")), strict=True)
            found = []
            for value, own in zip(fp, names, strict=True):
                if own != key:
                    found += local_links(values, radius)
                    key, values = own, []
                values.append(value)
            if found:
                yield out(found)
        yield out(local_links(values, radius))

    return dealt.mapInArrow(tidy(run), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs(doc_id, text).

    Documents link at fingerprints that differ in at most radius bits; component_id is the smallest doc_id that links
    reach, a document's own included. Texts without words, null ones too, have fingerprint zero and link like any other.
    Repeated rows each get their row; null doc_ids are kept, but never are a component's id unless alone. Extra columns
    are left out.
    """
    own = cut(fingerprints(docs))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _rooted(distinct, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct(fp, ...) with root, the same for all fingerprints that links reach."""
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, of several of it that of the smallest text hash.

    A null doc_id counts as the largest: such a row stays if no row with an id is in its component. Of exact repeats
    (doc_id and text) one is kept, whichever comes first.
    """
    own = cut(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    named = _rooted(own.groupBy("fp").agg(F.min(row).alias("first")), radius)
    kept = cut(named.groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias("_doc"), F.col("x.h").alias("_h")))
    known = docs.withColumns({"_own_doc": F.col("doc_id").cast("long"), "_own_h": F.expr(TEXT_HASH)})

    def rows(of: DataFrame) -> DataFrame:
        return known.join(of, known["_own_doc"].eqNullSafe(of["_doc"]) & (known["_own_h"] == of["_h"]), "left_semi")

    repeated = own.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = cut(kept.join(repeated, kept["_doc"].eqNullSafe(repeated["doc_id"]) & (kept["_h"] == repeated["h"]), "left_semi"))
    if repeated.isEmpty():
        return rows(kept).select(*docs.columns)
    once = kept.alias("k").join(repeated.alias("r"), F.col("k._doc").eqNullSafe(F.col("r._doc")) & (F.col("k._h") == F.col("r._h")), "left_anti")
    return rows(once).unionByName(rows(repeated).dropDuplicates(["_own_doc", "_own_h"])).select(*docs.columns)
