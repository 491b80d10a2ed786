"""Structured Streaming versions of the incremental loops: session logs, access counters, rate audit, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators.parse import carried, session_lines
from memlake.sources.tailing import follow_logs
from memlake.streaming import sink


TURNS = "path string, line_no long, dialect string, role string, text string, timestamp string, cwd string, session_id string"
ACCESS = "entry_id {key}, access_count long, last_accessed timestamp"


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, pattern: str = "*.jsonl", **trigger):
    """Append the lines that logs below ``folder`` have got since the last run to a table under ``root``, each once: files
    are followed by byte, and a micro-batch that is repeated after a failure is not written again."""
    parsed = lambda batch: session_lines(batch.withColumnRenamed("offset", "line_no"))
    return sink.start(follow_logs(spark, folder, pattern), parsed, root, checkpoint, **trigger)


def ingested_turns(spark: SparkSession, root: str, cap: int = 800) -> DataFrame:
    """The turns of all lines ingested so far, the same as a batch read of the whole logs gives, however they came."""
    return carried(sink.committed(spark, root, TURNS).drop("query", "epoch"), cap)


def count_access(events: DataFrame, root: str, checkpoint: str, **trigger):
    """Add up a stream of retrievals (entry_id, ts) in a table under ``root``: a row an entry and micro-batch, each
    micro-batch once, whatever fails in between."""
    counted = lambda batch: batch.groupBy("entry_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").cast("timestamp").alias("last_accessed"))
    return sink.start(events, counted, root, checkpoint, **trigger)


def access_totals(spark: SparkSession, root: str, key: str = "bigint") -> DataFrame:
    """(entry_id, access_count, last_accessed) of what ``count_access`` has counted: the side table of the overlay."""
    parts = sink.committed(spark, root, ACCESS.format(key=key))
    return parts.groupBy("entry_id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))


def access_counts(events: DataFrame) -> DataFrame:
    """Running (entry_id, access_count, last_accessed) of an event stream, in update mode."""
    return events.groupBy("entry_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))


def repeated_access(events: DataFrame, least: int = 3) -> DataFrame:
    """Entries retrieved often enough to be promoted."""
    return access_counts(events).where(F.col("access_count") >= least)


def rate_windows(events: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """Calls by key and hour, and whether they stayed within the limit; hours close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", "1 hour"), "key").agg(F.count(F.lit(1)).alias("calls"))
    return w.select(F.col("window.start").alias("hour"), "key", "calls", (F.col("calls") <= limit).alias("allowed"))


def once(mutations: DataFrame, keep: str = "72 hours") -> DataFrame:
    """Each mutation id once within the time that results are kept."""
    return mutations.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["mutation_id"])
