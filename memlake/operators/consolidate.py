"""Consolidation requests within the order of other mutations: all-or-nothing, with merged lists and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from memlake.functions.scoring import appended, note, stored_tier
from memlake.operators.mutate import STATE, fold, latest_first
from memlake.operators.replay import LISTS, TEXTS
from memlake.plans.tables import delete_stored, stored

#: Columns of a request; of an optional one that is missing nothing is asked.
REQUEST = ("mutation_id", "ts", "keep_id", "archive_ids", "expected_revisions", "updated_view", "confidence", "context_type", "reason", "actor_id")
OPTIONAL = ("updated_view", "confidence", "context_type", "reason", "actor_id")


def _requests(requests: DataFrame) -> DataFrame:
    """Each mutation id once, as first sent; ids to archive without repeats and without the kept one."""
    for c in OPTIONAL:
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast("string"))
    first = F.row_number().over(W.partitionBy("mutation_id").orderBy("ts", "keep_id"))
    ids = F.filter(F.array_distinct("archive_ids"), lambda i: i != F.col("keep_id"))
    return requests.select(*REQUEST).withColumn("__r", first).where("__r = 1").drop("__r").withColumn("archive_ids", F.coalesce(ids, F.array().cast(requests.schema["archive_ids"].dataType)))


def _status(type_of) -> F.Column:
    """What becomes of a request with its entries in ``m`` (at, entry_id, e), the kept one first."""
    there = F.filter("m", lambda x: x["e"].isNotNull())
    kinds = F.array_distinct(F.transform(there, lambda x: type_of(x["e"])))
    expected = lambda x: F.try_element_at("expected_revisions", x["entry_id"])
    return (
        F.when(F.size("archive_ids") == 0, "invalid_request").when(F.size(kinds) > 1, "mixed_entry_types").when(F.exists("m", lambda x: expected(x).isNull()), "invalid_request")
        .when((kinds[0] == "project") & (F.col("updated_view").isNotNull() | F.col("confidence").isNotNull()), "unsupported_entry_type")
        .when(F.size(there) < F.size("m"), "not_found").when(F.exists("m", lambda x: F.coalesce(x["e"]["archived"], F.lit(False))), "archived")
        .when(F.exists("m", lambda x: expected(x) != F.coalesce(x["e"]["revision"], F.lit(0))), "conflict").otherwise("ok")
    )


def _kept(columns: list[str], schema) -> dict[str, F.Column]:
    """The kept entry's columns after a request, by name."""
    e, knowledge = F.col("m")[0]["e"], F.col("kind") == "knowledge"
    all_of = lambda c: F.transform("m", lambda x: x["e"][c])
    put = {c: e[c] for c in columns}
    for c in set(LISTS) & set(columns):
        put[c] = F.array_distinct(F.flatten(F.transform(all_of(c), lambda v: F.coalesce(v, F.array().cast(schema[c].dataType)))))
    for c in set(TEXTS) & set(columns):
        put[c] = F.coalesce(F.try_element_at(F.filter(all_of(c), lambda v: v.isNotNull() & (v != "")), F.lit(1)), e[c])
    for names, extreme in ((("first_seen", "created_at"), F.array_min), (("last_seen", "last_accessed"), F.array_max)):
        put |= {c: extreme(all_of(c)) for c in names if c in columns}
    total = lambda c: F.aggregate(all_of(c), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0))).cast(schema[c].dataType)
    if "access_count" in put:
        put["access_count"] = total("access_count")
    if "mention_count" in put:
        named = F.size(put["sources"]).cast(schema["mention_count"].dataType) if "sources" in put else F.lit(0)
        put["mention_count"] = F.greatest(F.lit(1), F.when(named > 0, named).otherwise(total("mention_count")))
    if "links" in put:
        over = F.transform("archive_ids", lambda i: F.struct(i.alias("knowledge_id"), F.lit("supersedes").alias("relationship")))
        rest = F.filter(put["links"], lambda x: ~((x["relationship"] == "contradicts") & F.array_contains("archive_ids", x["knowledge_id"])))
        put["links"] = F.when(knowledge, F.array_union(rest, over.cast(schema["links"].dataType))).otherwise(put["links"])
    put["view"] = F.coalesce("updated_view", e["view"])
    put["confidence"] = F.coalesce("confidence", e["confidence"])
    put["state"] = F.when(knowledge, "active").otherwise(e["state"])
    put["context_type"] = F.coalesce("context_type", e["context_type"])
    if "tier" in put:
        put["tier"] = F.when(F.col("context_type").isNotNull(), stored_tier(F.lit(None).cast("int"), F.col("context_type"))).otherwise(e["tier"]).cast(schema["tier"].dataType)
    if "classification_status" in put:
        put["classification_status"] = F.when(F.col("context_type").isNotNull(), "manual_override").otherwise(e["classification_status"])
    return put | {"revision": F.coalesce(e["revision"], F.lit(0)) + 1} | _stamped(columns, e, F.lit("consolidate_entries"))


def _stamped(columns: list[str], e, action) -> dict[str, F.Column]:
    out = {"updated_at": F.col("ts"), "updated_by": F.col("actor_id")}
    if "notes" in columns:
        why = F.concat(F.coalesce("reason", F.lit("")), F.lit(" ("), F.col("mutation_id"), F.lit(")"))
        out["notes"] = appended(e["notes"], note(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("operator"), action, why), 20)
    return {c: v for c, v in out.items() if c in columns}


def _archived(columns: list[str]) -> dict[str, F.Column]:
    """An archived entry's columns after a request, by name; ``e`` is what it was."""
    e = F.col("e")
    put = {c: e[c] for c in columns} | {"archived": F.lit(True), "revision": F.coalesce(e["revision"], F.lit(0)) + 1} | _stamped(columns, e, F.lit("archive_entry"))
    if "access_count" in put:
        put["access_count"] = F.lit(0)
    if "last_accessed" in put:
        put["last_accessed"] = F.lit(None)
    return put


def _settled(entries: DataFrame, requests: DataFrame, touch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with m and status, entries after them), for requests that share no entry. A request's entries meet in
    one row, which is no larger than the request is."""
    columns, schema = entries.columns, entries.schema
    type_of = lambda e: F.coalesce(e["entry_type"], F.when(e["entry_id"].cast("string").startswith("pe_"), "project").otherwise("knowledge"))
    each = touch.join(entries.select(F.struct(*columns).alias("e"), F.col("entry_id")), "entry_id", "left")
    whole = each.groupBy("mutation_id").agg(F.array_sort(F.collect_list(F.struct("at", "entry_id", "e"))).alias("m"))
    told = requests.join(whole, "mutation_id").withColumn("kind", F.coalesce(F.when(F.col("m")[0]["e"].isNotNull(), type_of(F.col("m")[0]["e"])), F.lit("knowledge")))
    told = stored(told.withColumn("status", _status(type_of)), "consolidate-told")
    fine = told.where("status = 'ok'")
    typed = lambda put: [v.cast(schema[c].dataType).alias(c) for c, v in put.items()]
    kept = fine.select(*typed(_kept(columns, schema)))
    gone = fine.select("*", F.explode(F.slice("m", 2, F.size("m"))).alias("x")).withColumn("e", F.col("x.e")).select(*typed(_archived(columns)))
    changed = kept.unionByName(gone)
    return told, entries.join(changed.select("entry_id"), "entry_id", "left_anti").unionByName(changed)


def consolidate_in_order(entries: DataFrame, mutations: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """entries, results (entry_id, mutation_id, status, revision), consolidations (mutation_id, keep_id, status, revision)
    and archive rows, after ``mutations`` (as in ``mutate.fold``) and ``requests`` (see REQUEST) in one order of time and
    mutation id.

    A request is ok, or nothing of it happens: invalid_request (nothing to archive, or an entry without an expected
    revision), mixed_entry_types, unsupported_entry_type (a view or confidence for projects), not_found, archived or
    conflict. The kept entry takes the others' lists, counts and times, loses ``contradicts`` links to them and gets
    ``supersedes`` ones; the others are archived with a snapshot.

    Requests are taken in rounds: those that come first for each of their entries share none, so one round settles all
    of them, after the other mutations that come before. Rounds are as many as the longest chain of requests over shared
    entries, and each shuffles only what requests touch; entries that none touches are folded once. No group of entries
    that requests connect is ever brought together. Repeated mutation ids count once, as first sent."""
    columns = entries.columns
    r = stored(_requests(requests), "consolidate-requests")
    touch = stored(r.select("mutation_id", "ts", F.posexplode(F.concat(F.array("keep_id"), "archive_ids")).alias("at", "entry_id")), "consolidate-touch")
    ids = stored(touch.select("entry_id").distinct(), "consolidate-ids")
    moves = stored(latest_first(mutations), "consolidate-moves")

    def folded(part: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        after, results = fold(part, events)
        rest = part.select("entry_id", *[c for c in columns if c not in STATE and c != "entry_id"])
        after = after.join(rest, "entry_id", "left")
        if "entry_type" in columns:
            after = after.withColumn("entry_type", F.coalesce("entry_type", F.when(F.col("entry_id").cast("string").startswith("pe_"), "project").otherwise("knowledge")))
        return after.select(*columns), results

    others, results = folded(entries.join(ids, "entry_id", "left_anti"), moves.join(ids, "entry_id", "left_anti"))
    live, inside = stored(entries.join(ids, "entry_id", "left_semi"), "consolidate-live"), stored(moves.join(ids, "entry_id", "left_semi"), "consolidate-inside")
    done, archive, rounds = [], [], 0
    while not touch.isEmpty():
        first = touch.groupBy("entry_id").agg(F.min(F.struct("ts", "mutation_id")).alias("bar"))
        mine = touch.join(first, "entry_id").groupBy("mutation_id").agg(F.bool_and(F.col("bar.mutation_id") == F.col("mutation_id")).alias("ready"))
        ready = stored(mine.where("ready").select("mutation_id"), "consolidate-ready")
        now = touch.join(ready, "mutation_id", "left_semi")
        bars = now.select("entry_id", F.struct("ts", "mutation_id").alias("bar"))
        split = stored(inside.join(bars, "entry_id", "left").withColumn("__now", F.coalesce(F.struct("ts", "mutation_id") < F.col("bar"), F.lit(False))).drop("bar"), "consolidate-split")
        part, told = folded(live, split.where("__now").drop("__now"))
        results = results.unionByName(told)
        settled, after = _settled(stored(part, "consolidate-part"), r.join(ready, "mutation_id", "left_semi"), now)
        done.append(settled)
        after = stored(after, "consolidate-live")
        left = stored(touch.join(ready, "mutation_id", "left_anti"), "consolidate-touch")
        for old in (live, touch, inside):
            delete_stored(old)
        live, touch, inside, rounds = after, left, stored(split.where("not __now").drop("__now"), "consolidate-inside"), rounds + 1
    part, told = folded(live, inside)
    out = {"entries": others.unionByName(part), "results": results.unionByName(told)}
    if not done:
        none = F.lit(None)
        out["consolidations"] = r.select("mutation_id", "keep_id", none.cast("string").alias("status"), none.cast("int").alias("revision"))
        out["archive"] = entries.limit(0).select("entry_id", none.cast("string").alias("run_id"), none.cast("timestamp").alias("archived_at"), none.cast("string").alias("reason"), F.struct(*columns).alias("snapshot"))
        return out
    all_of = done[0]
    for more in done[1:]:
        all_of = all_of.unionByName(more)
    held = F.col("m")[0]["e"]["revision"]
    out["consolidations"] = all_of.select("mutation_id", "keep_id", "status", F.when(F.col("status") == "ok", F.coalesce(held, F.lit(0)) + 1).otherwise(held).cast("int").alias("revision"))
    why = F.concat(F.coalesce("reason", F.lit("")), F.lit(" (consolidated into "), F.col("keep_id").cast("string"), F.lit(")"))
    snaps = all_of.where("status = 'ok'").select(F.col("mutation_id").alias("run_id"), F.col("ts").cast("timestamp").alias("archived_at"), why.alias("reason"), F.explode(F.slice("m", 2, F.size("m"))).alias("x"))
    out["archive"] = snaps.select("x.entry_id", "run_id", "archived_at", "reason", F.col("x.e").alias("snapshot"))
    return out
