"""URL filters by a sort-merge range join.

The host of a url is turned into a canonical key: its labels reversed, each closed by a dot, so that a rule's host and
all its subdomains are the keys with one prefix, which is an interval of the sorted keys. With the path as second sort
column, urls and the starts of the rules' intervals are sorted together and swept once. A stack holds the nested rules
that are open at the current key: a rule is pushed at its start, and popped at the first key outside its interval. The
rules that fit a url are on the stack; among those whose path starts the url's path the longest wins.

The sorted range is dealt out in buckets between splitter keys (page_id is the last sort column, so a host with a third
of all urls is spread as well). A rule goes to each bucket that its interval meets, so that a bucket is swept on its
own. Splitters are a bounded sample; they set the balance, never the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import session, tidy

#: Splitters come from about so many urls a bucket, those of the lowest hashes.
SAMPLE_PER_BUCKET = 64

OUT = "page_id long, host string, path string, rule string, verdict string"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """df with host and path: of a null url, or one without ://, both are empty."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", lower_ascii(host)).withColumn("path", path)


def key_of(host: Column) -> Column:
    """a.b.com to com.b.a. ; the empty host to the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bytes(x: str | None) -> bytes:
    return (x or "").encode()


def _splitters(urls: DataFrame, buckets: int) -> list[tuple[bytes, bytes, int]]:
    """Keys that cut a sample of about SAMPLE_PER_BUCKET urls a bucket evenly. Few urls need no cuts."""
    wanted, n = SAMPLE_PER_BUCKET * buckets, urls.count()
    if n < wanted:
        buckets = max(1, n // SAMPLE_PER_BUCKET)
    top = min(1.0, wanted / max(1, n)) * 2.0**64 - 2.0**63
    rows = urls.filter(F.xxhash64("page_id", "key", "path").cast("double") <= top).select("key", "path", "page_id").distinct().collect()
    points = sorted((_bytes(r.key), _bytes(r.path), r.page_id or 0) for r in rows)
    return sorted({points[i * len(points) // buckets] for i in range(1, buckets)}) if points else []


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages(page_id, url).

    rules(host, path, verdict): path begins with / or is empty. A rule fits its host and all subdomains if the url's
    path starts with the rule's path. The longest host wins, then the longest path; of rules with the same host and
    path, the one with the smaller verdict text. Where none fits, rule is null and verdict the default. Null and
    malformed urls have empty host and path, which no rule fits; rules with a null or empty host are no rules. Repeated
    rows each get their row, extra columns are left out, and either table may be empty.
    """
    spark = session(pages)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = with_parts(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url"), "url")
    urls = urls.select("page_id", "host", "path", key_of(F.col("host")).alias("key"))
    split = spark.sparkContext.broadcast(_splitters(urls, buckets))  # at most one key a bucket

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, ids, kinds = (batch.column(c).to_pylist() for c in ("key", "path", "page_id", "kind"))
            rows, at = [], []
            for i, (k, p, d, rule) in enumerate(zip(keys, paths, ids, kinds, strict=True)):
                k = _bytes(k)
                if rule:
                    # The interval from (k, "") to the first key without the prefix k.
                    low = bisect_right(split.value, (k, b"", -(1 << 63)))
                    high = bisect_right(split.value, (k[:-1] + bytes([k[-1] + 1]), b"", -(1 << 63)))
                else:
                    low = high = bisect_right(split.value, (k, _bytes(p), d or 0))
                rows += [i] * (high - low + 1)
                at += range(low, high + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], names=["bucket", *batch.schema.names])

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, stack = None, []  # of (key, rules of that key: [(path, verdict, host)])
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                if c["bucket"][i] != bucket:
                    bucket, stack = c["bucket"][i], []
                key, path = c["key"][i] or "", c["path"][i] or ""
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if c["kind"][i]:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    stack[-1][1].setdefault(path, (c["verdict"][i], c["host"][i]))
                    continue
                found = None
                for _, own in reversed(stack):
                    fits = _longest(own, path)
                    if fits is not None:
                        found = (own[fits][1] + fits, own[fits][0])
                        break
                out.append((c["page_id"][i], c["host"][i], path, *(found or (None, default))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.string()) for x in columns[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    host = lower_ascii(F.col("host"))
    starts = rules.filter("host is not null and host <> ''").select(
        F.lit(None).cast("long").alias("page_id"), host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), key_of(host).alias("key"), F.lit(True).alias("kind"), F.col("verdict").cast("string").alias("verdict")
    )
    events = urls.withColumn("kind", F.lit(False)).withColumn("verdict", F.lit(None).cast("string")).unionByName(starts)
    schema = "bucket int, page_id long, host string, path string, key string, kind boolean, verdict string"
    # Rules stand before the urls of their key: false sorts below true, so by not kind.
    ordered = events.mapInArrow(tidy(dealt), schema).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", F.col("kind").desc(), "path", "verdict")
    return ordered.mapInArrow(tidy(swept), OUT)


def _longest(own: dict[str, tuple], path: str) -> str | None:
    """The longest of a host's rule paths that starts path: by looking up path's prefixes, or the rules if fewer."""
    if len(own) <= len(path):
        return max((p for p in own if path.startswith(p)), key=len, default=None)
    return next((path[:n] for n in range(len(path), -1, -1) if path[:n] in own), None)
