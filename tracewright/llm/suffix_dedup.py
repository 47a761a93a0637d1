"""Removal of long repeated substrings with distributed difference-cover suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that starts at two places of the corpus; strings of SHORTER bytes
that do are reported, not removed. A suffix array of the whole corpus has a row for every byte and level, many times the
disk of the limits, so the suffixes are thinned first, by steps that lose no repeat:

1. Anchors. Of the short strings (half of the least length) inside the bytes from a place, the one of the least hash is
   the place's anchor. It depends on those bytes only, so equal strings have equal anchors at equal offsets. Places with
   the same anchor are a run. A run whose anchor occurs nowhere else has no repeats.
2. Runs that are equal as a whole, with all bytes that their strings span (by BLAKE2b, 128 bits), repeat as a whole. Only
   one of them is needed as a witness for others. Both counts are combined before the shuffle, so a passage in a third of
   all documents costs a row a task.
3. What is left are the distinct runs of a shared anchor: the edges of repeats. Equal strings meet under one anchor, so
   the bytes are dealt out by anchor and suffix-sorted in blocks by difference cover: positions not divisible by three
   are the sample; their triples are sorted and named; the names are sorted in turn (recursion) until they are unique or
   cover LENGTH bytes; the remaining suffixes are merged in by their first byte and the rank of the suffix behind.
   Neighbours in the order are compared on their first bytes: those equal to one are repeats.
4. The runs of an anchor fill as many blocks as they need. Blocks of one anchor send what their orders have in names of
   their distinct strings (BLAKE2b, 128 bits), packed, to ranges of the names; there neighbours are compared once more.

In a block equal hashes of neighbours only propose a repeat; the bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import as_bytes, mark, release, session, stored, tidy

#: Strings of LENGTH bytes are removed; those of SHORTER bytes, about 50 words of prose, are reported too.
LENGTH, SHORTER = 400, 250
#: Bytes of a block that is suffix-sorted, and the most runs of one anchor in it.
BLOCK_BYTES, BLOCK_RUNS = 1_000_000, 1500

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shorter long"
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = (_table(11), _table(12))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as texts have needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, 1 << 16) * 2
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(self.base, -1, 1 << 64), np.uint64)]))


POWERS = tuple(Powers(b) for b in BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of byte values times powers: the hash of any part in two steps."""
    p = POWERS[which]
    p.to(len(raw) + 1)
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[which][raw] * p.up[: len(raw)], out=out[1:])
    return out


def _part(sums: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    return _mix((sums[b] - sums[a]) * POWERS[which].down[a] + (b - a).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by block prefixes and suffixes."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, length: int = LENGTH, least: int = SHORTER) -> tuple[np.ndarray, ...]:
    """key, two halves of the digest, first and last place of each run of a text's places, the last one from which
    `length` bytes follow, and the anchor. Places are those from which `least` bytes follow."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < least:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 4
    gram = least // 2
    sums = _sums(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = _part(sums, at, at + gram)
    # Least hash, leftmost of equal ones.
    anchor = (_sliding_min(grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    whole = np.frombuffer(b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    where = _mix((anchor[first] - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64))
    return grams[anchor[first]], whole[:, 0] + where, whole[:, 1], first, last, np.minimum(last, len(raw) - length), anchor[first]


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of t (values from 1) in the order of their suffixes' first `depth` values at least; ties in any order."""
    return _difference_cover(t.astype(np.int64), depth)


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits (ties in any order), and the keys in it."""
    low = max(1, len(key) - 1).bit_length()
    if bits + low <= 63:  # sorted with their places, which is faster than an indirect sort
        both = np.sort(key << low | np.arange(len(key)))
        return both & ((1 << low) - 1), both >> low
    order = np.argsort(key)
    return order, key[order]


def _difference_cover(t: np.ndarray, depth: float) -> np.ndarray:
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    x = np.concatenate([t, np.zeros(3, np.int64)])
    bits = int(t.max()).bit_length()
    # The sample: positions 1 and 2 modulo 3 (and n, where that is 1 modulo 3, to keep the two runs apart).
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    a, b, c = x[sample], x[sample + 1], x[np.minimum(sample + 2, n + 2)]
    if 3 * bits <= 63:
        order, key = _ordered(a << (2 * bits) | b << bits | c, 3 * bits)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((c, b, a))
        fresh = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if names.max() < len(sample) and depth > 3:
        order = _difference_cover(names, depth / 3)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    # The rest, by first value and the rank behind; merged by counting the sample suffixes below each.
    rest = np.arange(0, n, 3)
    low = int(rank.max()).bit_length()
    by_one = lambda i: x[i] << low | rank[i + 1]
    order, ones = _ordered(by_one(rest), bits + low)
    rest = rest[order]
    of_ones, of_twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    below = np.searchsorted(by_one(of_ones), ones)
    if 2 * bits + low <= 63:
        by_two = lambda i: (x[i] << bits | x[i + 1]) << low | rank[i + 2]
        below = below + np.searchsorted(by_two(of_twos), by_two(rest))
    else:
        both = np.concatenate([of_twos, rest])
        o = np.lexsort((np.concatenate([np.ones(len(of_twos)), np.zeros(len(rest))]), rank[both + 2], x[both + 1], x[both]))
        is_rest = o >= len(of_twos)
        counts = np.cumsum(~is_rest)[is_rest]
        places = np.empty(len(rest), np.int64)
        places[o[is_rest] - len(of_twos)] = counts
        below = below + places
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(below) + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = ordered
    return out


class Strings:
    """The strings of one size at the places of a block's spans, in suffix order."""

    def __init__(self, twice: np.ndarray, first: np.ndarray) -> None:
        #: For each place: whether its string occurs twice in the block, and whether it is the first of its string.
        self.twice, self.first = twice, first


def repeats(spans: list[bytes], counts: list[list[int]], sizes: list[int], anchors: list[int] | None = None, gram: int = 1) -> list[Strings]:
    """Of each size: the strings at the first counts[size][span] places of each span, in the order of spans and places.

    With anchors, all strings of a span hold the `gram` bytes from there on: these sort as one symbol, named by their bytes.
    """
    lengths = np.array([len(s) for s in spans])
    raw = np.frombuffer(b"\0".join(spans), np.uint8)
    t = raw.astype(np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    t[starts[1:] - 1] = 1
    index = np.arange(len(t))
    if anchors is not None:
        symbols: dict[bytes, int] = {}
        at = starts + np.array(anchors)
        t[at] = [258 + symbols.setdefault(s[a : a + gram], len(symbols)) for s, a in zip(spans, anchors, strict=True)]
        edge = np.zeros(len(t) + 1, np.int8)
        edge[at + 1] = 1
        edge[at + gram] -= 1
        kept = np.cumsum(edge[:-1]) == 0
        t, index = t[kept], np.cumsum(kept) - 1
    order = suffix_array(t, max(sizes) - gram + 1)
    sums = [_sums(raw, which) for which in (0, 1)]
    out = []
    for size, own in zip(sizes, counts, strict=True):
        n = np.array(own, np.int64)
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        number = np.full(len(t), -1, np.int64)
        number[index[places]] = np.arange(len(places))
        ranked = number[order]
        ranked = ranked[ranked >= 0]
        at = places[ranked]
        fresh = np.ones(len(at), bool)
        if len(at):
            same = np.ones(len(at) - 1, bool)
            for which in (0, 1):
                h = _part(sums[which], at, at + size, which)
                same &= h[1:] == h[:-1]
            fresh[1:] = ~same
            fresh = _verified(raw, at, fresh, size)
        twice, first = np.zeros(len(places), bool), np.zeros(len(places), bool)
        again = np.flatnonzero(~fresh)
        twice[ranked[again]] = True
        twice[ranked[again - 1]] = True
        first[ranked[fresh]] = True
        out.append(Strings(twice, first))
    return out


def _verified(raw: np.ndarray, at: np.ndarray, fresh: np.ndarray, size: int) -> np.ndarray:
    """fresh: which of the sorted places start a string unlike their neighbour's, by hash; now by bytes.

    Each place is compared with the least place of its group. Where the place before it is compared with the place before
    that one, only the last byte is new; so a long repeat is read once.
    """
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(at, np.flatnonzero(fresh))[group]
    i = np.flatnonzero(at != least)
    a, b = at[i], least[i]
    o = np.lexsort((a, a - b))
    a, b = a[o], b[o]
    chain = np.zeros(len(a), bool)
    chain[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
    wrong = raw[a + size - 1] != raw[b + size - 1]
    heads = np.flatnonzero(~chain)
    step = np.arange(size)
    for k in range(0, len(heads), 1 << 13):
        h = heads[k : k + (1 << 13)]
        wrong[h] = (raw[a[h][:, None] + step] != raw[b[h][:, None] + step]).any(1)
    if not wrong.any():
        return fresh
    # A collision of both hashes: all neighbours are compared.
    return np.concatenate([[True], [raw[p : p + size].tobytes() != raw[q : q + size].tobytes() for p, q in zip(at[1:].tolist(), at[:-1].tolist(), strict=True)]]).astype(bool)


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Start and last index of each run of true."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2) - [0, 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """d, r and text: d and r name a row by its id and content, so that repeated ids do not mix."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64("doc_id", "text").alias("r"), F.col("text"))


def repeated_places(docs: DataFrame, length: int = LENGTH, shorter: int | None = SHORTER) -> DataFrame:
    """d, r, size, first, last: ranges of places of docs(doc_id, text) whose strings of `size` bytes start elsewhere too,
    for the sizes length and shorter."""
    if shorter and shorter >= length:
        raise ValueError("shorter must be below length")
    sizes = sorted({length, shorter or length})
    least = sizes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [runs(x, length, least) for x in as_bytes(batch.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x[0]) for x in own]))
            c = [np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.int64) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("d").take(rows), batch.column("r").take(rows), *(pa.array(x.view(np.int64)) for x in c[:3]), *(pa.array(x.astype(np.int32)) for x in c[3:])], names=["d", "r", "key", "wa", "wb", "first", "last", "long", "anchor"])

    spark = session(docs)
    keyed = _keyed(docs)
    # What a later stored table stands for is deleted at once: places of all runs take as much disk as the texts.
    start = mark(spark)
    found = stored(keyed.mapInArrow(tidy(run), "d long, r long, key long, wa long, wb long, first int, last int, long int, anchor int"))
    # Stored, so that the join deals out both sides anew and Spark can split the runs of a frequent anchor.
    alike = (F.min("wa") == F.max("wa")) & (F.min("wb") == F.max("wb"))
    shared = stored(found.groupBy("key").agg(F.count("*").alias("c"), alike.alias("alike")).filter("c > 1").select("key", "alike"))
    here = stored(found.join(shared, "key"))
    release(spark, start, mark(spark) - 1)
    start = mark(spark) - 1
    place = ["d", "r", "first", "last", "long", "anchor"]
    mixed = here.filter("not alike").drop("alike")
    distinct = stored(mixed.groupBy("key", "wa", "wb").agg(F.count("*").alias("c"), F.min(F.struct(*place)).alias("at")))
    # Joins with frequent keys are stored on their own: within a larger plan Spark does not split them.
    several = stored(mixed.join(distinct.filter("c > 1").select("key", "wa", "wb"), ["key", "wa", "wb"]).select(*place))
    whole = stored(here.filter("alike").select(*place)).unionByName(several)
    release(spark, start, start + 1)
    start += 1
    ranges = F.array(*(F.struct(F.lit(z).alias("size"), "first", (F.col("long") if z == length else F.col("last")).alias("last")) for z in sizes))
    whole = whole.select("d", "r", F.explode(ranges).alias("x")).select("d", "r", "x.*").filter("last >= first")

    many = stored(distinct.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_RUNS))
    wanted = stored(distinct.join(many, "key", "left").select("key", "n", (F.col("c") == 1).alias("open"), "at.*"))
    release(spark, start, start + 1)
    start = mark(spark) - 2
    wanted = wanted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("d", "r", "first"), F.ceil(F.col("n") / BLOCK_RUNS)), F.lit(0)).cast("int"))
    asked = wanted.groupBy("d", "r").agg(F.collect_list(F.struct("key", "salt", F.col("n").isNotNull().alias("dealt"), "open", "first", "last", "long", "anchor")).alias("asked"))
    names = ["key", "salt", "dealt", "open", "d", "r", "first", "last", "long", "anchor"]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, r, text, own in zip(batch.column("d").to_pylist(), batch.column("r").to_pylist(), as_bytes(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                rows += [(x["key"], x["salt"], x["dealt"], x["open"], d, r, x["first"], x["last"], x["long"], x["anchor"], text[x["first"] : x["last"] + length]) for x in own]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "span"])

    # One row of text for each name: repeated rows are alike.
    texts = keyed.join(asked, ["d", "r"]).dropDuplicates(["d", "r"])
    bytes_of = texts.mapInArrow(tidy(spans), "key long, salt int, dealt boolean, open boolean, d long, r long, first int, last int, long int, anchor int, span binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bytes_of.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "d", "r", "first")
    cuts = [(b << 64) // n for b in range(1, n)]

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held, last = [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            counts = [[max(0, (x["long"] if z == length else x["last"]) - x["first"] + 1) for x in held] for z in sizes]
            within, strings = [], []
            for z, own, count in zip(sizes, repeats([x["span"] for x in held], counts, sizes, [x["anchor"] - x["first"] for x in held], least // 2), counts, strict=True):
                at = np.concatenate([[0], np.cumsum(count)])
                for x, a, b in zip(held, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    twice, first = own.twice[a:b], own.first[a:b]
                    if x["open"]:
                        within += [(x["d"], x["r"], z, x["first"] + i, x["first"] + j) for i, j in _ranges(twice).tolist()]
                    if x["dealt"]:
                        strings += [(blake2b(x["span"][i : i + z], digest_size=16).digest(), x["d"], x["r"], x["first"] + i, z, x["open"] and not twice[i]) for i in np.flatnonzero(first).tolist()]
            yield _rows(-1, within)
            if strings:
                strings.sort()
                at = np.searchsorted(np.array([int.from_bytes(s[0][:8], "big") for s in strings], np.uint64), np.array(cuts, np.uint64))
                edges = [0, *at.tolist(), len(strings)]
                for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if i < j:
                        yield _named(b, strings[i:j])

        for batch in batches:
            for x in batch.to_pylist():
                if bytes_held > BLOCK_BYTES and (x["key"], x["salt"]) != last:
                    yield from out()
                    held, bytes_held = [], 0
                last = (x["key"], x["salt"])
                held.append(x)
                bytes_held += len(x["span"])
        if held:
            yield from out()

    blocks = stored(dealt.mapInArrow(tidy(sort_blocks), BLOCK_ROWS))
    release(spark, start, start + 2)  # many and wanted
    places = "d long, r long, size int, first int, last int"
    within = blocks.filter("bucket < 0").mapInArrow(tidy(_unpacked), places)
    across = blocks.filter("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_across), places)
    return whole.unionByName(within).unionByName(across)


#: What a block sends: its ranges (bucket -1), or its distinct strings' names of one range of names, as packed arrays.
BLOCK_ROWS = "bucket int, names binary, d binary, r binary, size binary, first binary, last binary, wants binary"
FIELDS = (("d", np.int64), ("r", np.int64), ("size", np.int32), ("first", np.int32), ("last", np.int32), ("wants", np.bool_))


def _packed(bucket: int, names: bytes, columns: list) -> pa.RecordBatch:
    raw = [names, *(np.array(c, kind).tobytes() for c, (_, kind) in zip(columns, FIELDS, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["bucket", "names", *(f for f, _ in FIELDS)])


def _rows(bucket: int, ranges: list[tuple]) -> pa.RecordBatch:
    return _packed(bucket, b"", [*(list(zip(*ranges, strict=True)) or [()] * 5), ()])


def _named(bucket: int, strings: list[tuple]) -> pa.RecordBatch:
    name, d, r, first, size, wants = zip(*strings, strict=True)
    return _packed(bucket, b"".join(name), [d, r, size, first, first, wants])


def _columns(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(f)[i].as_buffer(), kind) for f, kind in FIELDS]


def _as_places(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:5]], names=[f for f, _ in FIELDS[:5]])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _as_places(_columns(batch, i))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of several blocks that are alike, as ranges of one place; rows come sorted by bucket."""
    bucket, held = None, []

    def out() -> pa.RecordBatch:
        names = np.concatenate([x[0] for x in held])
        columns = [np.concatenate(c) for c in zip(*(x[1] for x in held), strict=True)]
        order = np.lexsort((names["b"], names["a"], columns[2]))
        names, columns = names[order], [c[order] for c in columns]
        same = (names[1:] == names[:-1]) & (columns[2][1:] == columns[2][:-1])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return _as_places([c[twice & columns[5]] for c in columns])

    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column("bucket")[i].as_py()
            if bucket is not None and b != bucket:
                yield out()
                held = []
            bucket = b
            held.append((np.frombuffer(batch.column("names")[i].as_buffer(), np.dtype([("a", np.uint64), ("b", np.uint64)])), _columns(batch, i)))
    if held:
        yield out()


def _cover(row: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start and end of the merged byte spans of ranges of places."""
    at, end = row << 32 | first, row << 32 | (last + size)
    order = np.argsort(at)
    at, upto = at[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], at[1:] > upto[:-1]])[: len(at)])
    upto = upto[np.append(new[1:], len(at))[: len(new)] - 1]
    low = (1 << 32) - 1
    return at[new] >> 32, at[new] & low, upto & low


def _marked(docs: DataFrame, length: int, shorter: int | None) -> DataFrame:
    """doc_id, text and ranges (of repeated places: size, first, last; or null) of each row."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ranges = repeated_places(docs, length, shorter).groupBy("d", "r").agg(F.collect_list(F.struct("size", "first", "last")).alias("ranges"))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("doc_id", "text").alias("r"), "text").join(ranges, ["d", "r"], "left").select("doc_id", "text", "ranges")


def _spans(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_cover() of the ranges of one size in rows of _marked()."""
    ranges = batch.column("ranges")
    n = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
    sizes, first, last = (x.to_numpy().astype(np.int64) for x in ranges.flatten().flatten())
    own = sizes == size
    return _cover(np.repeat(np.arange(len(n)), n)[own], first[own], last[own], size)


def _cut(texts: list[bytes], spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[bytes, list[int]]]:
    """What is left of each text, and the edges of what goes."""
    row, a, b = spans
    edges = np.stack([a, b], 1).reshape(-1).tolist()
    at = (2 * np.searchsorted(row, np.arange(len(texts) + 1))).tolist()
    for text, i, j in zip(texts, at[:-1], at[1:], strict=True):
        own = edges[i:j]
        ends = [0, *own, len(text)]
        yield b"".join([text[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)]) if own else text, own


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text (binary: the bytes that stay), spans (removed ones: start, end, ...) and n_bytes of each row.

    Texts count as UTF-8 bytes (null: empty); strings never cross texts, and are judged on the input. Texts under
    `length` bytes lose nothing. Repeated rows each get their row, and are each other's repeats. Cuts may fall inside a
    character, so text is binary. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            kept, gone = zip(*_cut(texts, _spans(batch, length)), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(gone, pa.list_(pa.int64())), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "text", "spans", "n_bytes"])

    return _marked(docs, length, None).mapInArrow(tidy(run), "doc_id long, text binary, spans array<long>, n_bytes long")


def report(docs: DataFrame, length: int = LENGTH, shorter: int | None = SHORTER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shorter of each row of docs(doc_id, text), as from dedup().

    n_shorter counts bytes covered by strings of `shorter` bytes that start elsewhere too (of which those of `length`
    bytes are a part); they are not removed. Without `shorter` it is 0. Null texts are empty; repeated rows each get
    their row; an empty table gives no rows; extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            total = lambda x: pa.array(np.bincount(x[0], x[2] - x[1], len(texts)).astype(np.int64))
            gone, also = _spans(batch, length), _spans(batch, shorter or 0)
            digests = [sha256(kept).hexdigest() for kept, _ in _cut(texts, gone)]
            n_spans = pa.array(np.bincount(gone[0], minlength=len(texts)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), total(gone), n_spans, pa.array(digests, pa.string()), total(also)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shorter"])

    return _marked(docs, length, shorter).mapInArrow(tidy(run), OUT)
