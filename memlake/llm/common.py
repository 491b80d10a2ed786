"""Shared helpers: shared-folder tables, word patterns, connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.plans.tables import CLEANUP, clear_stored, delete_stored, shared_dir, stored

__all__ = ["clear_stored", "connected_components", "delete_stored", "names_kept", "quoted", "saved", "shared_dir", "small_batches", "stored", "where_late", "words_of"]

#: A word of the white-space family: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def quoted(name: str):
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def names_kept(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents whose helper columns begin with two underscores: columns of the documents that begin so
    too are put by under other names, and come back under their own."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = set(docs.columns)
        held = {c: next(n for i in range(len(taken) + 1) if (n := f"held{i}{c.rstrip('_')}") not in taken) for c in docs.columns if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(held) if held else docs, *args, **options)
        return out.withColumnsRenamed({v: k for k, v in held.items()}) if held else out

    return run


def where_late(df: DataFrame, condition: str) -> DataFrame:
    """``df.where(condition)`` evaluated above the projections that make its columns. Pushed below them, a condition
    over columns derived in many steps would repeat all of those steps once for every use."""
    row = F.monotonically_increasing_id()
    return df.withColumn("__row", row).where(F.expr(condition) & (F.col("__row") >= 0)).drop("__row")


def words_of(text) -> F.Column:
    """Array of the white-space words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what an Arrow batch of long texts can hold in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def saved(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet packed by zstd; the shuffle files of its query go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (columns a, b).

    Alternates large-star and small-star steps until the edge set is stable; each round is one checkpointed table,
    so lineage stays short and nothing but two counters reaches the driver. Every node of ``edges`` gets a row.
    A star centre's neighbours are never gathered: both steps are a grouped minimum and an equi-join, whose hot keys
    adaptive execution splits. The join is on the complement of the node, so that it has exchanges of its own: those of
    the minimum could not be split.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.bitwise_not("u").alias("k"), "m")
        large = both.withColumn("k", F.bitwise_not("u")).join(low, "k").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")
        small = large.withColumn("k", F.bitwise_not("u")).join(low, "k").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        new = stored(small, "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        delete_stored(e)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
