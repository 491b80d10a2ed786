"""Access feedback, promotion, archive, restore, ranked and budgeted index, the nightly cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake import policy as P
from memlake.functions.scoring import appended, note, salience, shortened, stored_tier
from memlake.operators import replay
from memlake.operators.filters import archive_candidate, promotion_candidate


def with_access(entries: DataFrame, access: DataFrame) -> DataFrame:
    """Overlay of side counters (entry_id, access_count, last_accessed): the larger count, the later time."""
    side = access.select("entry_id", F.col("access_count").alias("__n"), F.col("last_accessed").alias("__t"))
    df = entries.join(side, "entry_id", "left")
    return df.withColumns({"access_count": F.greatest(F.coalesce("access_count", F.lit(0)), F.coalesce("__n", F.lit(0))), "last_accessed": F.greatest("last_accessed", "__t")}).drop("__n", "__t")


def with_scores(entries: DataFrame, now) -> DataFrame:
    """Recompute salience and tier on read."""
    s = salience(F.col("confidence"), F.col("context_type"), F.col("mention_count"), F.col("last_seen"), F.col("last_accessed"), now)
    return entries.withColumns({"salience": s, "tier": stored_tier(F.col("tier"), F.col("context_type"))})


def reconsolidated(entries: DataFrame, hits: DataFrame, now, least: int = 3) -> DataFrame:
    """After the retrievals of ``hits`` (entry_id, ts): counts up, last access later, task queries retrieved often are
    recurring patterns of tier 2, with a note; salience follows."""
    seen = hits.groupBy("entry_id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__t"))
    df = entries.join(seen, "entry_id", "left")
    df = df.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("__n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "__t")})
    up = F.col("__n").isNotNull() & (F.col("context_type") == "task_query") & (F.col("access_count") >= least)
    df = df.withColumn("__up", F.coalesce(up, F.lit(False)))
    said = note(F.date_format("last_accessed", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("retrieval"), F.lit("promote"), F.concat(F.lit("access_count="), F.col("access_count").cast("string")))
    df = df.withColumns({
        "context_type": F.when(F.col("__up"), "recurring_pattern").otherwise(F.col("context_type")), "tier": F.when(F.col("__up"), 2).otherwise(F.col("tier")),
        "notes": F.when(F.col("__up"), appended(F.col("notes"), said, 20)).otherwise(F.col("notes")),
    })
    return with_scores(df.drop("__n", "__t"), now).withColumnRenamed("__up", "promoted")


def bucket(context_type: Column, tier: Column, salient: Column) -> Column:
    forever = context_type.isin(*[k for k, v in P.HALF_LIVES.items() if v is None])
    return F.when(forever | (tier == 1) | (salient >= P.STABLE_SALIENCE), "stable").when(salient >= P.DECAY_SALIENCE, "active").when(salient >= P.ARCHIVE_SALIENCE, "weak").otherwise("decay_candidate")


def archive_candidates(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranked by salience, then last change, then id."""
    ok = archive_candidate(F.col("context_type"), F.col("mention_count"), F.col("access_count"), F.col("salience"), P.ARCHIVE_SALIENCE)
    df = entries.where(ok).orderBy("salience", F.col("updated_at").asc_nulls_first(), "entry_id")
    return df.limit(limit) if limit is not None else df


def promotion_candidates(entries: DataFrame, limit: int | None = None) -> DataFrame:
    ok = promotion_candidate(F.col("context_type"), F.col("mention_count"), F.col("access_count"), F.size("sources"), P.PROMOTE_MENTIONS)
    df = entries.where(ok).orderBy(F.col("mention_count").desc(), F.col("access_count").desc(), F.col("salience").desc(), F.col("updated_at").desc_nulls_last(), "entry_id")
    return df.limit(limit) if limit is not None else df


def promoted(entries: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Entries of ``ids`` as recurring patterns of tier 2; others as they are."""
    df = entries.join(ids.select("entry_id", F.lit(True).alias("__up")).distinct(), "entry_id", "left")
    up = F.col("__up").isNotNull()
    df = df.withColumns({"context_type": F.when(up, "recurring_pattern").otherwise(F.col("context_type")), "tier": F.when(up, 2).otherwise(F.col("tier"))})
    return with_scores(df.drop("__up"), now)


def archived(entries: DataFrame, ids: DataFrame, run_id: str, now, reason: str) -> tuple[DataFrame, DataFrame]:
    """(entries with the archived flag, snapshot rows to append). Vectors of the ids go by an anti join."""
    df = entries.join(ids.select("entry_id", F.lit(True).alias("__gone")).distinct(), "entry_id", "left")
    rows = df.where("__gone").drop("__gone")
    snap = rows.select("entry_id", F.lit(run_id).alias("run_id"), F.lit(now).cast("timestamp").alias("archived_at"), F.lit(reason).alias("reason"), F.struct(*rows.columns).alias("snapshot"))
    return df.withColumn("archived", F.coalesce("__gone", F.col("archived"))).drop("__gone"), snap


def restored(entries: DataFrame, archive: DataFrame, ids: DataFrame, keep_context: bool = False) -> DataFrame:
    """Entries of ``ids`` back from their latest snapshot: as explicit saves of tier 1, or with ``keep_context`` with
    what the snapshot says."""
    last = archive.join(ids.select("entry_id").distinct(), "entry_id", "left_semi").groupBy("entry_id").agg(F.max_by("snapshot", "archived_at").alias("s"))
    back = last.select("s.*").withColumn("archived", F.lit(False))
    if not keep_context:
        back = back.withColumns({"context_type": F.lit("explicit_save"), "tier": F.lit(1)})
    return entries.join(last, "entry_id", "left_anti").unionByName(back.select(*entries.columns))


def _live(entries: DataFrame) -> DataFrame:
    """Entries that an index may hold: not archived, and of topics not deprecated."""
    return entries.where(~F.coalesce("archived", F.lit(False)) & ~((F.col("entry_type") == "knowledge") & F.coalesce(F.col("state") == "deprecated", F.lit(False))))


def first_places(rows: DataFrame, order: list[Column], topics: int, projects: int) -> DataFrame:
    """The first topics and projects of ``rows`` in that order, with their place by type. Each kind is a sorted limit, of
    which every task keeps its own best rows only; places are then given to those few."""
    best = rows.where("entry_type <> 'project'").orderBy(*order).limit(topics).unionByName(rows.where("entry_type = 'project'").orderBy(*order).limit(projects))
    return best.withColumn("place", F.row_number().over(W.partitionBy("entry_type").orderBy(*order)))


def ranked(entries: DataFrame, topics: int = P.TOPIC_CAP, projects: int = P.PROJECT_CAP) -> DataFrame:
    """The first live topics and projects, with their place: tier, salience, last change, id."""
    order = [F.asc("tier"), F.desc("salience"), F.desc_nulls_last("updated_at"), F.asc("entry_id")]
    return first_places(_live(entries), order, topics, projects)


def thin_index(entries: DataFrame, topics: int = P.TOPIC_CAP, projects: int = P.PROJECT_CAP) -> DataFrame:
    """The ranked entries, summaries cut to 80."""
    state = F.when(F.col("state").isin("active", "contested", "stale"), F.col("state")).otherwise("active")
    return ranked(entries, topics, projects).select("entry_id", "entry_type", "place", "tier", "salience", shortened(F.col("narrative"), 80).alias("summary"), state.alias("state"), "label")


def patched_index(index: DataFrame, changed: DataFrame, topics: int = P.TOPIC_CAP, projects: int = P.PROJECT_CAP) -> DataFrame:
    """The index with ``changed`` entries replaced or put in, ranked and capped anew. Entries that are archived, and
    topics that are deprecated, leave it. The index holds no time of change, so of equal tiers and salience the smaller id
    stands first. What falls out of a full index is not known to it: rebuild where many entries leave."""
    old = index.join(changed.select("entry_id").distinct(), "entry_id", "left_anti")
    new = _live(changed).select(*[c for c in index.columns if c != "place"])
    order = [F.asc("tier"), F.desc("salience"), F.asc("entry_id")]
    return first_places(old.drop("place").unionByName(new), order, topics, projects).select(*index.columns)


def budgeted(index: DataFrame, budget: int, floor: int = 100, keep: float = 0.8) -> DataFrame:
    """The longest head of ranked rows (place, tokens) whose length is in n, 0.8 n, 0.64 n, ... (down to ``floor``) and
    fits the budget; plus over_budget where not even the last does. The lengths are a short sequence known from n, so
    one grouped sum by the next length above each place tells them all."""
    sizes = [index.count()]
    while sizes[-1] > floor:
        sizes.append(int(sizes[-1] * keep))
    step = F.array_min(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s >= F.col("place")))
    parts = {r["size"]: r["used"] for r in index.groupBy(step.alias("size")).agg(F.sum("tokens").alias("used")).collect()}
    used, fits = 0, []
    for size in sorted(sizes):
        used += parts.get(size) or 0
        if used <= budget:
            fits.append(size)
    return index.where(F.col("place") <= max(fits, default=min(sizes))).withColumn("over_budget", F.lit(not fits))


def budgeted_index(rows: DataFrame, budget: int, topics: int = 100, projects: int = 50, evolutions: int = 10, keep: float = 0.8) -> DataFrame:
    """The index within a token budget, from ranked rows (kind, place, tokens, short_tokens) of the kinds topic, project
    and evolution: rows that stay, with ``shortened`` and ``over_budget``.

    While it is over the budget, topics lose their last fifth as long as there are more than ``topics``, then projects as
    long as there are more than ``projects``, then evolutions go down to ``evolutions``; in the end all texts are cut
    to their short form, and over_budget tells whether even that is too long. So lengths go through short sequences
    known from the counts, and one grouped sum by the next length above each place tells the tokens of all of them."""
    n = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = {}
    for kind, floor in (("topic", topics), ("project", projects)):
        lengths[kind] = [n.get(kind, 0)]
        while lengths[kind][-1] > floor:
            lengths[kind].append(int(lengths[kind][-1] * keep))
    lengths["evolution"] = [n.get("evolution", 0)] + [evolutions] * (n.get("evolution", 0) > evolutions)
    step = F.coalesce(*[F.when(F.col("kind") == k, F.array_min(F.filter(F.array(*[F.lit(x).cast("long") for x in of]), lambda x: x >= F.col("place")))) for k, of in lengths.items()])
    used = {k: dict.fromkeys(sorted(of), (0, 0)) for k, of in lengths.items()}
    for r in rows.groupBy("kind", step.alias("step")).agg(F.sum("tokens").alias("t"), F.sum("short_tokens").alias("s")).collect():
        used[r["kind"]][r["step"]] = (r["t"] or 0, r["s"] or 0)
    for of in used.values():
        total = (0, 0)
        for size in sorted(of):
            total = of[size] = (total[0] + of[size][0], total[1] + of[size][1])
    last = {k: 0 for k in lengths}
    states = [dict(last)]
    for kind in ("topic", "project", "evolution"):
        for i in range(1, len(lengths[kind])):
            last = last | {kind: i}
            states.append(last)
    cost = lambda state, short: sum(used[k][lengths[k][i]][short and k != "evolution"] for k, i in state.items())
    fit = next((s for s in states if cost(s, False) <= budget), None)
    state, short = fit or states[-1], fit is None
    stays = F.coalesce(*[F.when(F.col("kind") == k, F.col("place") <= lengths[k][i]) for k, i in state.items()])
    return rows.where(stays).withColumns({"shortened": F.lit(short), "over_budget": F.lit(short and cost(state, True) > budget)})


def recent_evolutions(evolutions: DataFrame, now, days: int = 30, most: int = 10) -> DataFrame:
    """The newest changes (entry_id, date, delta) within ``days``, deltas cut to 60."""
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return evolutions.where((F.col("date") >= start)).orderBy(F.col("date").desc(), "entry_id").limit(most).withColumn("delta", shortened(F.col("delta"), 60))


def counts(entries: DataFrame) -> DataFrame:
    """By type: all, live by tier, archived, contested."""
    live = ~F.coalesce("archived", F.lit(False))
    return entries.groupBy("entry_type").agg(
        F.count(F.lit(1)).alias("entries"), *[F.count_if(live & (F.col("tier") == t)).alias(f"tier_{t}") for t in (1, 2, 3)],
        F.count_if(~live).alias("archived"), F.count_if(F.col("state") == "contested").alias("contested"),
    )


def cycle(entries: DataFrame, access: DataFrame, now, run_id: str, dry_run: bool = True, promote: int = 25, archive: int = 25) -> dict[str, DataFrame]:
    """The nightly cycle as tables: entries after it, snapshot rows, index and the run's row. A dry run finds the same
    candidates and changes nothing. Else duplicates are merged and the others archived, contradictions contested, then
    what is left is promoted or archived. Buckets are counted before any of it."""
    start = with_scores(with_access(entries, access), now)
    live = start.where("not coalesce(archived, false)")
    plan = replay.plans(live)
    run = live.agg(*[F.count_if(bucket(F.col("context_type"), F.col("tier"), F.col("salience")) == b).alias(b) for b in ("stable", "active", "weak", "decay_candidate")])
    merges = replay.fingerprints(live).select("entry_id", "fp").join(plan.where("plan = 'merge'").select("fp"), "fp")
    after, others = replay.consolidated(start, merges.select("fp"), run_id, now)
    # Contests touch other labels than merges, so both come from the same plan.
    against = replay.fingerprints(live).join(plan.where("plan = 'contest'").select("fp"), "fp", "left_semi")
    if not dry_run:  # what contradicts is looked for at once
        after = with_scores(replay.marked(after, replay.contradictions(against)), now)
    after, merged_snaps = archived(after, others, run_id, now, "merged duplicate")
    left = start if dry_run else after
    left = left.where("not coalesce(archived, false)")
    up, gone = promotion_candidates(left, promote), archive_candidates(left, archive)
    # One-row tables side by side.
    for part in (up.agg(F.count(F.lit(1)).alias("promotion_candidates")), gone.agg(F.count(F.lit(1)).alias("archive_candidates")), plan.agg(F.count_if(F.col("plan") == "merge").alias("merge_plans"), F.count_if(F.col("plan") == "contest").alias("contest_plans"))):
        run = run.join(F.broadcast(part))
    run = run.withColumns({"run_id": F.lit(run_id), "dry_run": F.lit(dry_run)})
    if dry_run:
        _, snaps = archived(start, gone.limit(0), run_id, now, "")
        return {"entries": start, "archive": snaps, "index": thin_index(start), "run": run}
    after, snaps = archived(promoted(after, up, now), gone, run_id, now, "low salience")
    return {"entries": after, "archive": merged_snaps.unionByName(snaps), "index": thin_index(after), "run": run}
