"""Tables that micro-batches are appended to exactly once, by a ledger of epochs beside the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = "query string, epoch long, rows long"


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def append_once(batch: DataFrame, epoch: int, root: str, query: str) -> bool:
    """Write a micro-batch unless the ledger has its epoch; tell whether it was written.

    The data go to a folder of their own, which a second attempt overwrites, and only then the ledger gets its row, in
    one file. So a run that stops in between leaves data that no reader sees, and one that stops after it is told to be
    done. ``query`` is what the checkpoint belongs to: another checkpoint counts its epochs anew."""
    spark = batch.sparkSession
    if not _ledger(spark, root).where((F.col("query") == query) & (F.col("epoch") == epoch)).isEmpty():
        return False
    place = f"{root}/data/query={query}/epoch={epoch}"
    batch.write.mode("overwrite").parquet(place)
    rows = spark.read.schema(batch.schema).parquet(place).count()
    spark.createDataFrame([(query, epoch, rows)], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return True


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all epochs in the ledger, with query and epoch. Epochs are folders, of which only those in the ledger
    are read; the ledger has a row an epoch, so it is small beside them."""
    ledger = _ledger(spark, root).select("query", "epoch").distinct()
    if ledger.isEmpty():
        return spark.createDataFrame([], f"{schema}, query string, epoch long")
    data = spark.read.schema(f"{schema}, query string, epoch long").parquet(f"{root}/data")
    return data.join(ledger, ["query", "epoch"], "left_semi")


def start(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, **trigger):
    """Start a query whose micro-batches, shaped like batch tables, are appended once each; by default all that is there."""
    def save(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_once(shape(batch), epoch, root, query)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
