"""Revision-checked mutations, folded entry by entry in order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.plans.tables import stored

STATE = ("revision", "archived", "view", "confidence", "state", "context_type", "insights")


def latest_first(mutations: DataFrame) -> DataFrame:
    """Each mutation_id once, as first sent: a replayed one gets the result that is stored."""
    w = W.partitionBy("mutation_id").orderBy("ts", "entry_id")
    return mutations.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _comparable(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


class Entry:
    """An entry as mutations come: whether it is there, its state, and its insights in comparable words."""

    def __init__(self, there: bool, state: dict | None):
        self.there = there
        self.state = state or {**dict.fromkeys(STATE), "revision": 0, "archived": False}
        self.state["insights"] = list(self.state["insights"] or [])
        self.told = set(map(_comparable, self.state["insights"]))

    def status(self, m: dict) -> str:
        s = self.state
        if m["kind"] == "create":
            if self.there:
                return "exists"
        elif not self.there:
            return "not_found"
        elif m["expected_revision"] is not None and m["expected_revision"] != s["revision"]:
            return "conflict"
        if s["archived"] and m["kind"] != "restore":
            return "archived"
        if not s["archived"] and m["kind"] == "restore":
            return "conflict"
        return "noop" if m["kind"] == "insight" and _comparable(m["insight"]) in self.told else "ok"

    def take(self, m: dict) -> str:
        """Apply a mutation if it can be; its status."""
        s, status = self.state, self.status(m)
        if status == "ok":
            s["revision"] = 1 if m["kind"] == "create" else s["revision"] + 1
            self.there = True
            if m["kind"] in ("create", "update"):
                s["view"] = s["view"] if m["view"] is None else m["view"]
                for c, other in (("confidence", "medium"), ("state", "active"), ("context_type", "explicit_save")):
                    s[c] = m[c] if m[c] is not None else s[c] if s[c] is not None else other
            if m["kind"] in ("archive", "restore"):
                s["archived"] = m["kind"] == "archive"
            if m["kind"] in ("create", "insight") and m["insight"] is not None:
                s["insights"].append(m["insight"])
                self.told.add(_comparable(m["insight"]))
        return status


def fold(entries: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, results): mutations (mutation_id, ts, kind, entry_id, expected_revision, view, confidence, state,
    context_type, insight) of kinds create, update, insight, archive and restore, applied to each entry in order of time.

    A result is ok, not_found, exists, archived, conflict (another revision was expected) or noop (an insight that is
    there in other words). Only what is ok counts the revision up. Entries and mutations are dealt by entry and sorted
    by time; a task sees them stream by and holds the state of one entry, told in a row each, so that an entry with many
    mutations takes time but no room."""
    key = entries.schema["entry_id"].dataType
    texts = ("view", "confidence", "state", "context_type")
    none = F.lit(None)
    before = entries.select("entry_id", F.lit(0).alias("side"), none.cast("timestamp").alias("ts"), none.cast("string").alias("mutation_id"), none.cast("string").alias("kind"), none.cast("int").alias("expected_revision"),
                            *texts, none.cast("string").alias("insight"), F.col("revision").cast("int").alias("revision"), F.coalesce("archived", F.lit(False)).alias("archived"), "insights")
    each = latest_first(mutations).select(F.col("entry_id").cast(key).alias("entry_id"), F.lit(1).alias("side"), F.col("ts").cast("timestamp").alias("ts"), "mutation_id", "kind", F.col("expected_revision").cast("int").alias("expected_revision"),
                                          *texts, "insight", none.cast("int").alias("revision"), none.cast("boolean").alias("archived"), none.cast("array<string>").alias("insights"))
    both = before.unionByName(each)
    both = both.repartition("entry_id").sortWithinPartitions("entry_id", "side", "ts", "mutation_id")
    out = f"entry_id {key.simpleString()}, mutation_id string, status string, revision int, archived boolean, view string, confidence string, state string, context_type string, insights array<string>"

    def run(batches):
        now, entry = (), None

        def row(mutation_id, status):
            whole, s = mutation_id is None, entry.state
            return {"entry_id": now[0], "mutation_id": mutation_id, "status": status, "revision": s["revision"], **{c: s[c] if whole else None for c in STATE if c != "revision"}}

        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                if now != (m["entry_id"],):
                    if now and entry.there:
                        rows.append(row(None, None))
                    now, there = (m["entry_id"],), m["side"] == 0
                    entry = Entry(there, {c: m[c] for c in STATE} if there else None)
                if m["side"] == 1:
                    status = entry.take(m)
                    rows.append(row(m["mutation_id"], status))
            if rows:
                yield _batch(rows)
        if now and entry.there:
            yield _batch([row(None, None)])

    def _batch(rows):
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(out))
    done = stored(both.mapInArrow(run, out), "mutation-fold")
    return done.where("status is null").select("entry_id", *STATE), done.where("status is not null").select("entry_id", "mutation_id", "status", "revision")


def consolidate(entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, results) of requests (mutation_id, keep_id, archive_ids, expected_revisions map): all entries must be
    there, live, of one type and at the expected revision, else nothing of the request happens. The kept entry's
    revision goes up, the others are archived. A request is a barrier: run it between folds of other mutations."""
    ids = requests.select("mutation_id", "keep_id", F.col("expected_revisions").alias("x"), F.explode(F.array_union(F.array("keep_id"), "archive_ids")).alias("entry_id"))
    df = ids.join(entries.select("entry_id", "entry_type", "revision", "archived"), "entry_id", "left")
    fine = F.coalesce(~F.col("archived") & (F.coalesce(F.try_element_at("x", "entry_id"), F.col("revision")) == F.col("revision")), F.lit(False))
    results = df.groupBy("mutation_id", "keep_id").agg(F.bool_and(fine).alias("fine"), (F.count_distinct("entry_type") == 1).alias("same"))
    results = results.select("mutation_id", "keep_id", F.when(F.col("fine") & F.col("same"), "ok").otherwise("conflict").alias("status"))
    done = df.select("mutation_id", "entry_id", "keep_id").join(results.where("status = 'ok'").select("mutation_id"), "mutation_id", "left_semi")
    mark = done.groupBy("entry_id").agg(F.bool_and(F.col("entry_id") != F.col("keep_id")).alias("__gone"))
    after = entries.join(mark, "entry_id", "left")
    after = after.withColumns({"revision": F.when(F.col("__gone").isNull(), F.col("revision")).otherwise(F.col("revision") + 1), "archived": F.coalesce("archived", F.lit(False)) | F.coalesce("__gone", F.lit(False))})
    return after.drop("__gone").select(*entries.columns), results


def with_link(links, other, relationship: str):
    """An array of (knowledge_id, relationship) with one more, unless it is there."""
    there = F.exists(links, lambda x: (x["knowledge_id"] == other) & (x["relationship"] == relationship))
    return F.when(there, links).otherwise(F.array_append(links, F.struct(other.alias("knowledge_id"), F.lit(relationship).alias("relationship"))))


def without_links(links, other, relationships: tuple[str, ...] = ()):
    return F.filter(links, lambda x: ~((x["knowledge_id"] == other) & (x["relationship"].isin(*relationships) if relationships else F.lit(True))))
