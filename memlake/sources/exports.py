"""Readers of exports and logs, and the store's tables on disk."""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.sources.json_array import read_elements

TREE = "uuid string, name string, created_at string, updated_at string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string,parent_message_uuid:string>>"
MAPPING = "title string, create_time double, update_time double, mapping map<string,struct<id:string,parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>>"


def newest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The file of a folder that changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.col("modificationTime").desc(), "path").first()
    return row and row["path"]


def read_tree_export(spark: SparkSession, path: str) -> DataFrame:
    """Message nodes (conv_id, id, parent_id, ord, role, text, created_at, ...) of an export with parent pointers: a list,
    an object with ``conversations``, or one conversation. A conversation that cannot be read is left out."""
    raw = spark.read.schema(f"{TREE}, conversations array<struct<{_struct(TREE)}>>").json(path, multiLine=True, mode="PERMISSIVE")
    inner = raw.where("conversations is not null").select(F.inline("conversations"))
    all_of = raw.where("conversations is null").drop("conversations").unionByName(inner).where("uuid is not null")
    return _tree_nodes(all_of)


def read_tree_array(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """The same nodes of exports that are one huge list each, read by many tasks. A conversation that is not as the schema
    says is left out."""
    one = F.from_json("element", TREE)
    return _tree_nodes(read_elements(spark, folder, pattern).select(one.alias("c")).select("c.*").where("uuid is not null"))


def _tree_nodes(all_of: DataFrame) -> DataFrame:
    m = all_of.select(F.col("uuid").alias("conv_id"), "name", "created_at", "updated_at", F.posexplode("chat_messages").alias("ord", "m"))
    return m.select("conv_id", F.col("m.uuid").alias("id"), F.nullif("m.parent_message_uuid", F.lit("")).alias("parent_id"), "ord", F.col("m.sender").alias("role"), F.col("m.text").alias("text"), F.nullif("m.created_at", F.lit("")).alias("created_at"), "name", "updated_at")


def read_mapping_export(spark: SparkSession, path: str) -> DataFrame:
    """The same nodes of an export whose conversations map ids to nodes; text parts are joined by line feeds."""
    raw = spark.read.schema(MAPPING).json(path, multiLine=True, mode="PERMISSIVE").where("mapping is not null")
    return _mapping_nodes(raw)


def read_mapping_array(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """The same nodes of exports with mappings, as ``read_tree_array`` reads them."""
    return _mapping_nodes(read_elements(spark, folder, pattern).select(F.from_json("element", MAPPING).alias("c")).select("c.*").where("mapping is not null"))


def _mapping_nodes(raw: DataFrame) -> DataFrame:
    n = raw.select(F.concat(F.lit("gpt_"), F.col("create_time").cast("long").cast("string")).alias("conv_id"), F.col("title").alias("name"), F.posexplode(F.map_values("mapping")).alias("ord", "n"))
    return n.select("conv_id", F.col("n.id").alias("id"), F.col("n.parent").alias("parent_id"), "ord", F.col("n.message.author.role").alias("role"), F.array_join(F.filter("n.message.content.parts", lambda p: p.isNotNull()), "\n").alias("text"), F.timestamp_seconds("n.message.create_time").cast("string").alias("created_at"), "name")


def _struct(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def read_session_logs(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, line) of log files below a folder. Large files are read by many tasks: a line's number is the byte
    its split begins at and its place in that split's rows, which is in order within a file but not dense."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return files.select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(id, date, subject, sender, recipients, content, html) of an mbox, split at its separator lines by the reader, each
    mail parsed by the standard library; plain text is preferred, the last part of a kind counts."""
    raw = spark.read.text(path, lineSep="\nFrom ")

    def run(frames):
        for f in frames:
            rows = []
            for text in f["value"]:
                m = email.message_from_string(text.partition("\n")[2], policy=email.policy.compat32)
                plain = html = None
                for part in m.walk():
                    body = part.get_payload(decode=True)
                    if body is not None and part.get_content_type() in ("text/plain", "text/html"):
                        said = body.decode(part.get_content_charset() or "utf-8", "replace")
                        plain, html = (said, html) if part.get_content_type() == "text/plain" else (plain, said)
                rows.append((m["Message-ID"], m["Date"], m["Subject"], m["From"], [t.strip() for t in (m["To"] or "").split(",") if t.strip()], plain, html))
            yield pd.DataFrame(rows, columns=["id", "date", "subject", "sender", "recipients", "content", "html"])

    return raw.mapInPandas(run, "id string, date string, subject string, sender string, recipients array<string>, content string, html string")


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a bundle {knowledge_entries: [{data}], project_entries: [..]}, of a struct schema."""
    raw = spark.read.schema(f"knowledge_entries array<struct<data:struct<{schema}>>>, project_entries array<struct<data:struct<{schema}>>>").json(path, multiLine=True)
    both = [raw.select(F.explode(c).alias("e")).select("e.data.*").withColumn("entry_type", F.lit(c.split("_")[0])) for c in ("knowledge_entries", "project_entries")]
    return both[0].unionByName(both[1])
