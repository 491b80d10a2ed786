"""Normalising, backfill, consistency checks, run records and change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from memlake import policy as P
from memlake.functions.scoring import filled, salience, stored_tier


def normalized(entries: DataFrame, now, backfill: bool = False) -> DataFrame:
    """Metadata with defaults filled in: distinct sources, mentions from them (with ``backfill``: else at least as
    stored), first and last times, tier of a known context type, salience, schema version."""
    sources = filled(F.coalesce("sources", F.array().cast("array<string>")))
    df = entries.withColumn("sources", sources)
    n = F.greatest(F.lit(1), F.size("sources"))
    df = df.withColumns({
        "mention_count": n if backfill else F.greatest(n, F.coalesce("mention_count", F.lit(0))), "access_count": F.greatest(F.lit(0), F.coalesce("access_count", F.lit(0))),
        "first_seen": F.coalesce("first_seen", "created_at", "updated_at"), "last_seen": F.coalesce("last_seen", "updated_at", "created_at"), "schema_version": F.lit(2),
    })
    known = F.col("context_type").isin(*P.CONTEXT_TYPES)
    df = df.withColumn("tier", F.when(known, stored_tier(F.col("tier"), F.col("context_type"))))
    return df.withColumn("salience", salience(F.col("confidence"), F.col("context_type"), F.col("mention_count"), F.col("last_seen"), F.col("last_accessed"), now))


def pending(entries: DataFrame, force: bool = False, done: DataFrame | None = None) -> DataFrame:
    """Entries still to classify, less those of a checkpoint."""
    df = entries if force else entries.where("coalesce(classification_status, '') <> 'complete' or context_type is null")
    return df if done is None else df.join(done.select("entry_id"), "entry_id", "left_anti")


def classified(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with the types that labels (entry_id, context_type) give, what is wrong with the labels: missing or
    unknown entries and types outside the allowed set)."""
    ok = labels.where(F.col("context_type").isin(*P.CONTEXT_TYPES)).groupBy("entry_id").agg(F.min("context_type").alias("__c"))
    df = entries.join(ok, "entry_id", "left")
    after = df.withColumns({"context_type": F.coalesce("__c", "context_type"), "classification_status": F.when(F.col("__c").isNotNull(), "complete").otherwise(F.col("classification_status"))}).drop("__c")
    ids = entries.select("entry_id", F.lit(1).alias("e"))
    both = ids.join(labels.select("entry_id", "context_type", F.lit(1).alias("l")), "entry_id", "full")
    issue = F.when(F.col("l").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.coalesce(F.col("context_type").isin(*P.CONTEXT_TYPES), F.lit(False)), "bad_type")
    return after, both.select("entry_id", issue.alias("issue")).where("issue is not null")


def consistency(entries: DataFrame, vectors: DataFrame, live_only: bool = True) -> DataFrame:
    """(entry_id, issue): missing metadata, stale schema, missing vector, and metadata of the vector that differs."""
    df = entries.where(~F.coalesce("archived", F.lit(False))) if live_only else entries
    v = vectors.select("entry_id", F.col("entry_type").alias("v_type"), F.col("state").alias("v_state"), F.lit(True).alias("has"))
    df = df.join(v, "entry_id", "left")
    issues = F.array(
        F.when(F.col("context_type").isNull(), "missing_metadata"), F.when(F.coalesce("schema_version", F.lit(0)) < 2, "stale_schema"), F.when(F.col("has").isNull(), "missing_vector"),
        F.when(F.col("has") & ~(F.col("v_type").eqNullSafe(F.col("entry_type")) & F.col("v_state").eqNullSafe(F.col("state"))), "metadata_mismatch"),
    )
    return df.select("entry_id", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def seeded_sample(entries: DataFrame, n: int, seed: int) -> DataFrame:
    return entries.orderBy(F.xxhash64("entry_id", F.lit(seed)), "entry_id").limit(n)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(conv_id, change): new, deleted, changed or unchanged by fingerprint."""
    a, b = before.select("conv_id", F.col("hash").alias("h1")), after.select("conv_id", F.col("hash").alias("h2"))
    change = F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "changed").otherwise("unchanged")
    return a.join(b, "conv_id", "full").select("conv_id", change.alias("change"))


def unprocessed(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return items.join(processed.select(key).distinct(), key, "left_anti")


def latest_run(runs: DataFrame) -> DataFrame:
    """(last_run, last_attempt): ids of the last run that counts as such and of the last at all; of equal times the
    greater id."""
    good = F.col("set_as_latest") & ~F.col("status").isin("skipped_locked", "failed")
    at = F.struct("run_at", "run_id")
    return runs.agg(F.max(F.when(good, at))["run_id"].alias("last_run"), F.max(at)["run_id"].alias("last_attempt"))


def run_issues(runs: DataFrame, now, hour: int = 7, minute: int = 10, late_minutes: int = 60) -> DataFrame:
    """What is wrong with each run against the last hh:mm UTC before ``now``."""
    t = F.lit(now).cast("timestamp")
    today = F.date_trunc("day", t) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    due = F.when(today <= t, today).otherwise(today - F.make_dt_interval(F.lit(1)))
    bad = F.array(
        F.when(F.col("run_at") < due, "before_window"), F.when(F.col("run_at") > due + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(late_minutes)), "late_start"),
        F.when(F.col("status") != "ok", "status"), F.when(F.col("trigger") != "cron", "trigger"), F.when(F.col("dry_run"), "dry_run"),
    )
    return runs.select("run_id", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ",").alias("issues"))


def run_cost(tokens_in, tokens_out, embedded):
    return F.round((tokens_in * 3 + tokens_out * 15 + embedded * 0.02) / 1e6, 6)


def trimmed_log(log: DataFrame, key: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key (ts, id)."""
    w = W.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    return log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def evidence_issues(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(entry_id, issue) of extracted entries (entry_id, label, insights array<struct<insight, message_ids>>): labels of
    one word, insights without messages, and messages that ``known`` (message_id) lacks. Entries are kept; only an empty
    list of insights drops one, which is the caller's filter."""
    label = entries.where(F.size(F.split(F.trim(F.coalesce("label", F.lit(""))), r"\s+")) < 2).select("entry_id", F.lit("short_label").alias("issue"))
    each = entries.select("entry_id", F.posexplode("insights").alias("n", "i"))
    bare = each.where(F.coalesce(F.size("i.message_ids"), F.lit(0)) <= 0).select("entry_id", F.concat(F.lit("insight_without_messages:"), F.col("n").cast("string")).alias("issue"))
    ids = each.select("entry_id", F.explode("i.message_ids").alias("message_id")).distinct()
    gone = ids.join(known.select("message_id").distinct(), "message_id", "left_anti").select("entry_id", F.concat(F.lit("unknown_message:"), F.col("message_id")).alias("issue"))
    return label.unionByName(bare).unionByName(gone)
