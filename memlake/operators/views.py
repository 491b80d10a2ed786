"""Views of entries: texts to embed or classify, labels, compact lists; conversion of extracted data; store reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake import policy as P
from memlake.operators import lifecycle

#: Characters of summaries in a compact index, and of a project's phase; fixed values.
TOPIC_SUMMARY, PROJECT_GOAL, PROJECT_PHASE = 100, 80, 60
#: Cents of dollars a million tokens: in, out; characters a message and a token; share of tokens that come out.
PRICE_IN, PRICE_OUT, MESSAGE_CHARS, TOKEN_CHARS, OUT_SHARE = 3.0, 15.0, 500, 100, 0.5


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _some(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def _joined(*parts: Column) -> Column:
    """Arrays of texts, stripped, those with anything left, put together."""
    return F.array_join(F.filter(F.transform(F.concat(*parts), stripped), lambda x: x != ""), " ")


def _first(texts: Column, n: int) -> Column:
    """The first ``n`` texts with anything in them."""
    told = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), stripped), lambda x: x != "")
    return F.slice(told, 1, n)


def embedding_text(e: dict[str, Column]) -> Column:
    """What is embedded of an entry: domain, view and three insights, or a project's name, goal and phase."""
    knowledge = _joined(F.array(e["domain"], e["view"]), _first(e["insights"], 3))
    return F.when(e["entry_type"] == "project", _joined(F.array(e["name"], e["goal"], e["phase"]))).otherwise(knowledge)


def classification_summary(e: dict[str, Column], most: int = 600) -> Column:
    """What a classifier reads: view, insights and abilities, or goal, phase, decisions and tools. Of lists the first few
    members count, empty ones among them."""
    head = lambda c, n: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)
    tools = F.when(F.size(e["tools"]) > 0, F.concat(F.lit("Tech stack: "), F.array_join(head(e["tools"], 6), ", ")))
    project = _joined(F.array(e["goal"], e["phase"]), head(e["decisions"], 2), F.array(tools))
    return F.substring(F.when(e["entry_type"] == "project", project).otherwise(_joined(F.array(e["view"]), head(e["insights"], 3), head(e["abilities"], 2))), 1, most)


def source_hint(weights: Column, sources: Column, repos: Column) -> Column:
    """Where an entry comes from: its weighted sources, or what the ids of its conversations say."""
    has = lambda *marks: F.exists(sources, lambda s: reduce(and_, [F.lower(s).rlike(m) for m in marks]))
    return (
        F.when(F.size(weights) > 0, F.array_join(F.array_sort(weights), ", ")).when(has("gmail|email"), "email").when(has("codex"), "codex transcript").when(has("claude", "code"), "claude_code transcript")
        .when(has("claude"), "claude_ai transcript").when(has("github"), "github").when(F.size(repos) > 0, "github-linked").otherwise("conversation transcript")
    )


def entry_label(domain: Column, name: Column, entry_id: Column) -> Column:
    return F.coalesce(_some(domain), _some(name), entry_id.cast("string"), F.lit("unknown"))


def updated_at(last_seen: Column, updated: Column, touched: Column) -> Column:
    return F.coalesce(_some(last_seen), _some(updated), _some(touched))


def narrative(e: dict[str, Column]) -> Column:
    """A view, or a project's goal, phase and what blocks it."""
    project = F.concat_ws(" ", *[_some(e[c]) for c in ("goal", "phase", "blocked")])
    return F.when(e["entry_type"] == "project", project).otherwise(F.coalesce(e["view"], F.lit("")))


def summary(told: Column, most: int = 160) -> Column:
    return F.substring(told, 1, most)


def compact_index(entries: DataFrame, topics: int = P.TOPIC_CAP, projects: int = P.PROJECT_CAP) -> DataFrame:
    """The ranked index as a client gets it: texts cut, dates as days, a missing tier as the last one."""
    top = lifecycle.ranked(entries, topics, projects)
    project = F.col("entry_type") == "project"
    told = F.when(project, F.substring(F.coalesce("narrative", F.lit("")), 1, PROJECT_GOAL)).otherwise(F.substring(F.coalesce("narrative", F.lit("")), 1, TOPIC_SUMMARY))
    return top.select(
        "entry_type", "place", "entry_id", "label", told.alias("summary"), F.when(project, F.substring(F.coalesce("phase", F.lit("")), 1, PROJECT_PHASE)).alias("phase"), "state",
        F.date_format("last_seen", "yyyy-MM-dd").alias("updated"), F.coalesce("tier", F.lit(3)).alias("tier"), "context_type", "salience", "mention_count",
    )


def context_view(e: dict[str, Column]) -> list[Column]:
    """The columns of an entry's short answer: five insights or decisions, repositories, whether more is kept."""
    project = e["entry_type"] == "project"
    return [
        F.slice(F.when(project, e["decisions"]).otherwise(e["insights"]), 1, 5).alias("points"), e["repos"].alias("related_repos"),
        F.coalesce(e["detail_level"] == "full", F.lit(False)).alias("has_full_content"),
    ]


def converted(extracted: DataFrame, project: bool = False) -> DataFrame:
    """Entries of extracted rows (conv_id, created_at, updated_at, n, label, view, confidence, phase, points
    array<struct<text, message_ids, snippet>>), n the row's number in its conversation. Knowledge needs a point, a
    project a name. Ids are hashes of conversation and number, so a second run makes no others; snippets are cut to
    200; the first position, or phase, has the first point's evidence."""
    point = lambda p: F.struct(p["text"].alias("text"), F.coalesce(p["message_ids"], F.array().cast("array<string>")).alias("message_ids"), F.substring(F.coalesce(p["snippet"], F.lit("")), 1, 200).alias("snippet"))
    df = extracted.withColumn("points", F.transform(F.coalesce("points", F.array().cast(extracted.schema["points"].dataType)), point))
    df = df.where(F.coalesce(F.col("label"), F.lit("")) != "") if project else df.where(F.size("points") > 0)
    history = F.when(F.coalesce(F.col("phase"), F.lit("")) != "", F.array("phase")) if project else F.when(F.coalesce(F.col("view"), F.lit("")) != "", F.array(F.col("view")))
    return df.select(
        F.concat(F.lit("pe_" if project else "ke_"), F.substring(F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("n").cast("string")), 256), 1, 12)).alias("entry_id"),
        F.lit("project" if project else "knowledge").alias("entry_type"), "label", "view", F.coalesce("confidence", F.lit("medium")).alias("confidence"), F.lit("active").alias("state"), F.lit("full").alias("detail_level"), "phase", "points",
        F.coalesce(history, F.array().cast("array<string>")).alias("history"), F.get("points", 0)["snippet"].alias("first_evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("points", lambda p: p["message_ids"])))).alias("source_messages"), F.array(F.col("conv_id").cast("string")).alias("sources"), "created_at", "updated_at",
    )


def alternate_branches(branches: DataFrame, similar: float = 0.9) -> DataFrame:
    """Of branches (conv_id, leaf, is_primary, text) those beside the primary one that say something else: a Jaccard
    similarity of words below ``similar``. Each meets its conversation's one primary branch by an equi-join."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    main = branches.where("is_primary").select("conv_id", words(F.col("text")).alias("__p"))
    both = branches.where("not is_primary").join(main, "conv_id").withColumn("__w", words(F.col("text")))
    alike = F.coalesce(F.try_divide(F.size(F.array_intersect("__w", "__p")), F.size(F.array_union("__w", "__p"))), F.lit(1.0))
    return both.withColumn("similarity", alike).where(F.col("similarity") < similar).drop("__p", "__w")


def text_gate(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows with enough text: 100 signs for a README, 150 for a mail."""
    return df.where(F.length(F.col(text)) >= least)


def restricted(entries: DataFrame, ids: DataFrame | None) -> DataFrame:
    """A cycle's entries: those of ``ids``, or all."""
    return entries if ids is None else entries.join(ids.select("entry_id").distinct(), "entry_id", "left_semi")


def skip_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """New entries whose id the store does not have."""
    return new.join(old.select("entry_id"), "entry_id", "left_anti")


def union_of_sources(*tables: DataFrame | None) -> DataFrame:
    """Rows of all tables that there are, by column name; a column that a table lacks is null there."""
    there = [t for t in tables if t is not None]
    out = there[0]
    for t in there[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def estimate(kept: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of what a run over ``kept`` conversations (message_count) would take, and how many are skipped."""
    a = kept.agg(F.count(F.lit(1)).alias("to_process"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"))
    b = skipped.agg(F.count(F.lit(1)).alias("to_skip"))
    tokens = F.expr(f"messages * {MESSAGE_CHARS} div {TOKEN_CHARS}")
    df = a.join(F.broadcast(b)).withColumn("tokens", tokens)
    cost = F.col("tokens") * PRICE_IN / 1e6 + F.col("tokens") * OUT_SHARE * PRICE_OUT / 1e6
    share = F.coalesce(F.try_divide(100 * F.col("to_skip"), F.col("to_skip") + F.col("to_process")), F.lit(0.0))
    return df.withColumns({"cost": F.round(cost, 6), "skippable": F.round(share, 4), "seconds": F.col("to_process") * 2, "entries": F.col("to_process") * 3})


def store_stats(entries: DataFrame, vectors: DataFrame, pending: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """One row on the store's health: entries by type, vectors and their width, entries to classify, errors of the last
    day that has any, and the last run. Each table is one aggregate; rows meet as one-row tables."""
    out = entries.agg(F.count_if(F.col("entry_type") == "knowledge").alias("knowledge"), F.count_if(F.col("entry_type") == "project").alias("projects"))
    days = errors.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    for part in (
        vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimensions")), pending.agg(F.count(F.lit(1)).alias("pending")),
        days.agg(F.coalesce(F.max_by("n", "day"), F.lit(0)).alias("errors_last_day")), runs.agg(F.max_by("run_id", F.struct("run_at", "run_id")).alias("last_run")),
    ):
        out = out.join(F.broadcast(part))
    return out


def remaining_unclassified(entries: DataFrame) -> DataFrame:
    """One row: live entries without a type, and whether a migration may be called complete."""
    n = F.count_if(F.col("context_type").isNull() & ~F.coalesce("archived", F.lit(False)))
    return entries.agg(n.alias("remaining")).withColumn("complete", F.col("remaining") == 0)


def complete_migration(entries: DataFrame) -> None:
    left = remaining_unclassified(entries).first()["remaining"]
    if left:
        raise ValueError(f"{left} entries are not classified yet")


def repo_activity_rank(accounts: list[DataFrame], most: int | None = None) -> DataFrame:
    """Repositories (name, pushed_at, updated_at) of several accounts, the newest activity first; ties by name."""
    active = F.coalesce("pushed_at", "updated_at")
    df = union_of_sources(*accounts).withColumn("active_at", active).orderBy(active.desc_nulls_last(), "name")
    return df if most is None else df.limit(most)


def merged_projects(old: DataFrame, new: DataFrame, found: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(store, log): projects (entry_id, label, phase, blocked, decisions, history, sources, updated_at) after new ones on
    those that ``found`` (new_id, old_id) names, in order of their id; the rest are new entries. A phase that differs
    from the one before joins the history, what blocks is overwritten if given, decisions are told apart by text."""
    log = new.select(F.col("entry_id").alias("new_id")).join(found, "new_id", "left").withColumn("action", F.when(F.col("old_id").isNull(), "create").otherwise("update"))
    part = new.join(found, new["entry_id"] == found["new_id"]).drop("entry_id")
    said = F.when(F.coalesce(F.col("phase"), F.lit("")) != "", F.col("phase"))
    order = W.partitionBy("old_id").orderBy("new_id")
    part = part.join(old.select(F.col("entry_id").alias("old_id"), F.col("phase").alias("__was")), "old_id").withColumn("__said", said)
    part = part.withColumn("__before", F.coalesce(F.last("__said", True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("__was")))
    steps = F.array_sort(F.collect_list(F.when(~F.col("__said").eqNullSafe(F.col("__before")) & F.col("__said").isNotNull(), F.struct("new_id", "phase"))))
    blocks = F.max_by("blocked", F.when(F.coalesce(F.col("blocked"), F.lit("")) != "", F.col("new_id")))
    told = F.array_sort(F.collect_list(F.struct("new_id", "decisions")))
    by = part.groupBy(F.col("old_id").alias("entry_id")).agg(
        F.transform(steps, lambda s: s["phase"]).alias("__steps"), F.when(F.count(F.when(F.coalesce(F.col("blocked"), F.lit("")) != "", 1)) > 0, blocks).alias("__blocked"),
        F.flatten(F.transform(told, lambda s: s["decisions"])).alias("__decisions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("__sources"),
    )
    df = old.join(by, "entry_id", "left")
    met = F.col("__steps").isNotNull()
    df = df.withColumns({
        "phase": F.when(F.size("__steps") > 0, F.element_at("__steps", -1)).otherwise(F.col("phase")), "history": F.when(met, F.concat("history", "__steps")).otherwise(F.col("history")),
        "blocked": F.coalesce("__blocked", "blocked"), "decisions": F.when(met, F.array_union("decisions", "__decisions")).otherwise(F.col("decisions")),
        "sources": F.when(met, F.array_sort(F.array_union("sources", "__sources"))).otherwise(F.col("sources")), "updated_at": F.when(met, now).otherwise(F.col("updated_at")),
    })
    made = new.join(log.where("action = 'create'").select(F.col("new_id").alias("entry_id")), "entry_id", "left_semi")
    return df.select(*old.columns).unionByName(made.select(*old.columns)), log


def pending_ids(entries: DataFrame, migrating: bool) -> DataFrame:
    """Ids to classify: while a migration is open those without a type, none after it."""
    return entries.where(F.col("context_type").isNull() & F.lit(migrating)).select("entry_id")


def with_vector_sources(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors (entry_id, embedding) with type, label, state, time and sources of their entries."""
    about = entries.select("entry_id", "entry_type", "label", "state", "updated_at", "sources")
    return vectors.select("entry_id", "embedding").join(about, "entry_id")


def error_log(errors: DataFrame, most: int = 100) -> DataFrame:
    """The newest ``most`` errors (ts, id, ...) of each day; every task keeps its own ``most`` first."""
    df = errors.withColumn("day", F.to_date("ts"))
    place = F.row_number().over(W.partitionBy("day").orderBy(F.col("ts").desc(), F.col("id").desc()))
    return df.withColumn("place", place).where(F.col("place") <= most)
