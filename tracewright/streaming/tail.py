"""Tailing a growing text file as a stream, and event-time windows."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "line long, text string"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.latest = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"
        self.most = int(options.get("maxbytes", options.get("maxBytes", 1 << 24)))

    def initialOffset(self) -> dict:
        if not self.latest or not os.path.exists(self.path):
            return {"byte": 0, "line": 0}
        with open(self.path, "rb") as f:
            raw = f.read()
        end = raw.rfind(b"\n") + 1
        return {"byte": end, "line": raw[:end].count(b"\n")}

    def _lines(self, start: dict, end: int | None) -> tuple[list[tuple[int, str]], dict]:
        """Whole lines from start, at most `most` bytes of them (one line at least) or up to byte end."""
        if not os.path.exists(self.path):
            return [], start
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            raw = f.read(self.most if end is None else end - start["byte"])
            while end is None and b"\n" not in raw and (more := f.read(self.most)):
                raw += more
        raw = raw[: raw.rfind(b"\n") + 1]
        found = raw.split(b"\n")[:-1]
        n = start["line"]
        rows = [(n + i + 1, x.rstrip(b"\r").decode("utf-8", "replace")) for i, x in enumerate(found)]
        return rows, {"byte": start["byte"] + len(raw), "line": n + len(found)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._lines(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start, end["byte"])[0])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """format("tail"): new whole lines of a growing file. Options: path, startingOffsets (earliest or latest), maxBytes.

    The offset is the byte and line reached, so a restarted query goes on where its checkpoint ends.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> StructType | str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def tail(spark: SparkSession, path: str, starting: str = "earliest") -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("startingOffsets", starting).load()


def write_append(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet", every: str | None = None, once: bool = False):
    """Appends to files; every: the trigger's interval (like 60 seconds); once: all that is there, then ends."""
    w = stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every or "60 seconds")).start()


def write_numbered(stream: DataFrame, write, checkpoint: str, once: bool = False):
    """Calls write(df, n) for each batch, where n counts them; df has the column snapshot = n."""
    w = stream.writeStream.foreachBatch(lambda df, n: write(df.withColumn("snapshot", F.lit(n)), n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """keys, start, n and total of value in windows of event time; late: how long a stream waits. Batch or stream."""
    own = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = own.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total")


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """keys, start, stop and n of sessions: runs of events with gaps below `gap`."""
    own = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = own.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def snapshot_due(ts: Column, every: str) -> Column:
    return F.window(ts, every)["start"]
