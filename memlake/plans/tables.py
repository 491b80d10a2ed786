"""Plans cut by tables in the shared folder, and global row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


#: Whether shuffle files go once a query has run; a stored table needs those of its own write no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where none is set (tests). On a
    cluster executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-checkpoint-")
        shared_dir.own = found
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/memlake/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of the application's own in the shared folder, that nothing else has."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_stored(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df.stored_path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all tables that this application has stored, once its results are written."""
    _delete(spark, _folder(spark))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Row numbers from 1 over the whole table: ranges of the order are numbered side by side and shifted by the number
    of rows in the ranges before. The ranges are stored, so that they are the same for both."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(before, "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
