"""Streams of landed files. Batch runs use the available-now trigger, so a job resumes from its checkpoint and ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from partlake.operators.relational import newest


def landing(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 1000) -> DataFrame:
    """Files of a folder as a stream, so many at once."""
    return timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path))


def timed(stream: DataFrame) -> DataFrame:
    """Event time with a zone (the session's), as watermarks need it."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has landed since the checkpoint, batch by batch, then end. ``each`` must be idempotent by batch id."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's finished rows to a Parquet folder, each exactly once."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def updates_once(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> DataFrame:
    """The latest state of each key of an updating stream, after all that has landed: one folder for each batch."""
    run_once(stream, checkpoint, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/run={n}"), "update")
    every = stream.sparkSession.read.option("basePath", path).parquet(f"{path}/run=*").drop("run")
    return newest(every, key, F.desc("batch")).drop("batch")


def tumbling(events: DataFrame, width: str, late: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; events later than ``late`` behind the newest are dropped with their windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Runs of a key's events without a gap."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_within(events: DataFrame, late: str, key: list[str]) -> DataFrame:
    """The first of each key's events within the watermark; state of older keys is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def enriched(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream with the columns of a static table."""
    return events.join(table, key, "left")


class LastDigest(StatefulProcessor):
    """Lets a key's row through only where its digest differs from the last one let through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digest = handle.getValueState("digest", "digest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.digest.get()[0] if self.digest.exists() else None
        for pdf in rows:
            fresh = []
            for d in pdf["digest"].tolist():
                fresh.append(d != last)
                last = d
            if any(fresh):
                yield pdf[fresh]
        if last is not None:
            self.digest.update((last,))

    def close(self) -> None:
        pass


def changed_only(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A stream of (key, digest) for rows whose columns changed since the key's last row; needs the RocksDB state store."""
    kind = rows.schema[key].dataType.simpleString()
    digests = rows.select(key, F.xxhash64(*columns).alias("digest"))
    return digests.groupBy(key).transformWithStateInPandas(LastDigest(), f"{key} {kind}, digest long", "append", "none")
