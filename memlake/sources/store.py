"""The store as Parquet snapshots: upserts write a new version beside the old one and then point to it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memlake.plans.tables import stored


def upserted(old: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """Rows of ``new`` over those of ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(entries: DataFrame, root: str, version: int) -> str:
    path = f"{root}/v={version:06d}"
    entries.write.partitionBy("entry_type").parquet(path)
    entries.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version that was written to its end."""
    last = spark.read.parquet(f"{root}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={last:06d}")


#: Hash partitions of a store that is kept in parts.
PARTS = 64


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, {part: the version that wrote it}) of the newest version that is complete, or of a given one: a row a
    part, of which there are as many as the store was made with."""
    rows = spark.read.schema("version int, part int, written int").parquet(f"{root}/manifest").where(F.lit(True) if version is None else F.col("version") == version)
    last = rows.groupBy("version").agg(F.collect_list(F.struct("part", "written")).alias("parts")).orderBy(F.col("version").desc()).first()
    if last is None:
        raise ValueError(f"no such version of {root}")
    return last["version"], {p["part"]: p["written"] for p in last["parts"]}


def _write_parts(entries: DataFrame, root: str, version: int, before: dict[int, int], parts: int, key: str) -> None:
    """Write the entries' parts, then the manifest that names them: readers see a version whole or not at all."""
    spark, part = entries.sparkSession, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    dealt = entries.withColumn("part", part).repartition("part")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{root}/parts/written={version}")
    now = {**before, **{r["part"]: version for r in spark.read.schema(dealt.schema).parquet(f"{root}/parts/written={version}").select("part").distinct().collect()}}
    rows = [(version, p, w) for p, w in sorted(now.items())]
    spark.createDataFrame(rows, "version int, part int, written int").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def create_parts(entries: DataFrame, root: str, parts: int = PARTS, key: str = "entry_id") -> None:
    """Version 1 of a store in ``parts`` hash partitions by ``key``, which rows of one key share. An empty part has no files,
    but for one that says what the columns are."""
    spark = entries.sparkSession
    spark.createDataFrame([(parts, key, entries.schema.json())], "parts int, key string, schema string").coalesce(1).write.parquet(f"{root}/layout")
    _write_parts(entries, root, 1, {p: 0 for p in range(parts)}, parts, key)


def _layout(spark: SparkSession, root: str) -> tuple[int, str, T.StructType]:
    row = spark.read.parquet(f"{root}/layout").first()
    return row["parts"], row["key"], T.StructType.fromJson(json.loads(row["schema"]))


def read_parts(spark: SparkSession, root: str, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """A version of a store in parts, by default the newest; its files stay as they are while later ones are written."""
    _, _, schema = _layout(spark, root)
    _, named = _manifest(spark, root, version)
    paths = [f"{root}/parts/written={w}/part={p}" for p, w in sorted(named.items()) if w and (only is None or p in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_parts(new: DataFrame, root: str) -> int:
    """The next version with ``new`` rows over those of their keys; only the parts that they fall into are read and
    written, all others are named again. Returns its number. One writer at a time."""
    spark = new.sparkSession
    parts, key, schema = _layout(spark, root)
    version, named = _manifest(spark, root)
    fresh = stored(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), "upsert")
    touched = {r["p"] for r in fresh.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("p")).distinct().collect()}
    if touched:
        _write_parts(upserted(read_parts(spark, root, version, touched), fresh, key), root, version + 1, named, parts, key)
    return version + bool(touched)


def point_lookup(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries by id; an id that begins with pe_ asks for a project."""
    asked = ids.select("entry_id", F.when(F.col("entry_id").startswith("pe_"), "project").otherwise("knowledge").alias("entry_type"))
    return entries.join(asked.distinct(), ["entry_id", "entry_type"], "left_semi")


def by_key(entries: DataFrame, key: str) -> DataFrame:
    """Secondary sets as rows (key, entry_id): ids by a field in lower case with underscores; unfilled fields have none.
    A set may hold most of the store, so none is gathered."""
    name = F.replace(F.lower(F.col(key)), F.lit(" "), F.lit("_"))
    return entries.select(name.alias(key), "entry_id").where(F.col(key) != "").distinct()


def snapshot(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def restore(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def vector_rows(entries: DataFrame) -> DataFrame:
    """What is kept beside each vector; of the sources the first three."""
    return entries.select("entry_id", "entry_type", "state", "updated_at", "context_type", "tier", F.coalesce("archived", F.lit(False)).alias("archived"), F.array_join(F.slice("sources", 1, 3), ",").alias("source"))


def archive_full_content(entries: DataFrame, root: str) -> DataFrame:
    """Entries' whole content, appended as JSON to a table under ``root``; the entries with a reference to it."""
    columns = [c for c in entries.columns if c != "full_content_ref"]
    entries.select("entry_id", F.to_json(F.struct(*columns)).alias("content")).write.mode("append").parquet(f"{root}/archive_content")
    return entries.withColumn("full_content_ref", F.concat(F.lit(f"{root}/archive_content/"), F.col("entry_id").cast("string")))


def full_content(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    return spark.read.parquet(f"{root}/archive_content").join(ids.select("entry_id").distinct(), "entry_id", "left_semi")


def reset_store(entries: DataFrame, root: str, version: int) -> DataFrame:
    """Write an empty version; tell how many entries of each type are gone."""
    gone = entries.groupBy("entry_type").agg(F.count(F.lit(1)).alias("entries"))
    told = entries.sparkSession.createDataFrame(gone.collect(), gone.schema)
    write_version(entries.limit(0), root, version)
    return told


def append_run_report(run: DataFrame, root: str) -> None:
    """Add a run's row to the table of runs."""
    run.write.mode("append").json(f"{root}/runs")


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(f"{root}/runs")
