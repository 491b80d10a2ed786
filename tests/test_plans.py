"""Plans of labels by bounds against all pairs, and labels of very many views."""

import random
import time

import pytest
from pyspark.sql import functions as F

from memlake.operators import lifecycle, replay, views

ENTRY = "entry_id string, entry_type string, label string, narrative string, confidence string"


def by_pairs(entries):
    groups = replay.fingerprints(entries).where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    said = replay.view_pairs(entries).groupBy("fp").agg(F.bool_or(F.col("reason").isNotNull()).alias("against"), F.bool_and("compatible").alias("agree"))
    return {r["fp"]: "contest" if r["against"] else "none" if r["agree"] is False else "merge" for r in groups.join(said, "fp", "left").collect()}


def test_bounds_decide_as_pairs_do(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for label in range(260):
        core = rng.sample(words, rng.choice([0, 1, 3, 8]))
        kind = "project" if label % 9 == 0 else "knowledge"
        for _ in range(rng.randint(1, 6)):
            text = core + rng.sample(words, rng.choice([0, 1, 2, 6, 20]))
            if rng.random() < 0.06:
                text.append(rng.choice(["outperform", "underperform", "bullish", "bearish", "rising", "falling"]))
            rng.shuffle(text)
            rows.append((f"e{len(rows)}", kind, f"label {label}", rng.choice([" ".join(text)] * 9 + [""]), rng.choice(["high", "high", "low"])))
    df = spark.createDataFrame(rows, ENTRY).repartition(5)
    want = by_pairs(df)
    assert {r["fp"]: r["plan"] for r in replay.plans(df).collect()} == want
    assert set(want.values()) == {"contest", "merge", "none"}


@pytest.mark.parametrize("shape,plan", [("alike", "merge"), ("apart", "contest"), ("opposed", "contest")])
def test_a_label_of_very_many_views(spark, shape, plan):
    """10^5 different views of one label: 5 * 10^9 pairs, of which none is looked at."""
    text = {
        "alike": "concat('one two three four five six seven eight nine ten view', id)", "apart": "concat('a', id, ' b', id, ' c', id, ' d', id)",
        "opposed": "concat('one two three four five six seven eight ', case when id = 7 then 'outperform' when id = 70000 then 'underperform' else 'x' end, ' view', id)",
    }[shape]
    df = spark.range(100_000).selectExpr("concat('e', id) entry_id", "'knowledge' entry_type", "'the label' label", f"{text} narrative", "'high' confidence")
    began = time.time()
    assert [(r["n_entries"], r["plan"]) for r in replay.plans(df).collect()] == [(100_000, plan)]
    assert time.time() - began < 120


def budget_loop(lists, budget):
    """The same as a plain loop over (tokens, short) lists of topics, projects and evolutions."""
    t, p, e = (list(x) for x in lists)
    cost = lambda: sum(x for part in (t, p, e) for x, _ in part)
    while cost() > budget:
        if len(t) > 100:
            t = t[: int(len(t) * 0.8)]
        elif len(p) > 50:
            p = p[: int(len(p) * 0.8)]
        elif len(e) > 10:
            e = e[:10]
        else:
            return len(t), len(p), len(e), True, sum(s for part in (t, p) for _, s in part) + sum(x for x, _ in e) > budget
    return len(t), len(p), len(e), False, False


def test_budgeted_index_equals_the_loop(spark):
    rng = random.Random(2)
    for sizes in ((300, 120, 30), (90, 130, 4), (0, 51, 11), (101, 0, 0), (5, 5, 5)):
        lists = [[(n := rng.randint(1, 40), min(n, 12)) for _ in range(size)] for size in sizes]
        lists[2] = [(n, n) for n, _ in lists[2]]
        rows = [(k, i + 1, *x) for k, part in zip(("topic", "project", "evolution"), lists) for i, x in enumerate(part)]
        df = spark.createDataFrame(rows, "kind string, place long, tokens long, short_tokens long").cache()
        total = sum(x for part in lists for x, _ in part)
        for budget in {total, total // 2, total // 5, 60, 0}:
            got = lifecycle.budgeted_index(df, budget).groupBy().agg(*[F.count_if(F.col("kind") == k) for k in ("topic", "project", "evolution")], F.max("shortened"), F.max("over_budget")).first()
            t, p, e, short, over = budget_loop(lists, budget)
            assert tuple(got) == (t, p, e, short, over) or (sum(got[:3]) == t + p + e == 0)
        df.unpersist()


INDEXED = "entry_id string, entry_type string, tier int, salience double, updated_at string, narrative string, state string, label string, archived boolean"


def indexed(spark, n, rng):
    rows = [(f"e{i:04}", rng.choice(["knowledge", "project"]), rng.randint(1, 3), rng.choice([0.1, 0.5, 0.9]), rng.choice([None, "2024", "2025"]), f"text {i}", rng.choice(["active", "deprecated", None]), f"l{i}", rng.choice([None, False, True])) for i in range(n)]
    return rows, spark.createDataFrame(rows, INDEXED)


def first_by_hand(rows, topics, projects, timed=True):
    """Entry ids by place, of live rows in the stated order."""
    live = [r for r in rows if not r[8] and not (r[1] == "knowledge" and r[6] == "deprecated")]
    live.sort(key=lambda r: r[0])
    if timed:
        live.sort(key=lambda r: r[4] or "", reverse=True)
    live.sort(key=lambda r: (r[2], -r[3]))
    return {kind: [r[0] for r in live if r[1] == kind][:most] for kind, most in (("knowledge", topics), ("project", projects))}


def places(df):
    rows = sorted(df.collect(), key=lambda r: r["place"])
    assert all([r["place"] for r in rows if r["entry_type"] == kind] == list(range(1, sum(r["entry_type"] == kind for r in rows) + 1)) for kind in ("knowledge", "project"))
    return {kind: [r["entry_id"] for r in rows if r["entry_type"] == kind] for kind in ("knowledge", "project")}


def test_indexes_rank_by_sorted_limits(spark):
    rng = random.Random(8)
    rows, df = indexed(spark, 120, rng)
    wide = df.withColumns({"phase": F.lit("p"), "last_seen": F.lit("2024-01-01").cast("timestamp"), "context_type": F.lit("task_query"), "mention_count": F.lit(1)})
    want = first_by_hand(rows, 7, 5)
    assert places(lifecycle.thin_index(df, 7, 5)) == places(views.compact_index(wide, 7, 5)) == want
    for made in (lifecycle.thin_index(df, 7, 5), views.compact_index(wide, 7, 5)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("TakeOrderedAndProject") == 2
    assert lifecycle.thin_index(df.limit(0)).count() == 0


def test_patched_index_replaces_and_drops(spark):
    rng = random.Random(9)
    rows, df = indexed(spark, 90, rng)
    rows = [r for r in rows if not r[8] and r[6] == "active"]
    index = lifecycle.thin_index(spark.createDataFrame(rows, INDEXED), 100, 50)
    changed = [(r[0], r[1], rng.randint(1, 3), 0.7, r[4], r[5], rng.choice(["active", "deprecated"]), r[7], rng.choice([False, True, None])) for r in rows[::3]] + [("new", "knowledge", 1, 0.95, None, "n", "active", "l", None)]
    patch = spark.createDataFrame(changed, INDEXED).withColumnRenamed("narrative", "summary")
    told = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    got = lifecycle.patched_index(index, patch, 6, 4)
    assert got.columns == index.columns and places(got) == first_by_hand(list(told.values()), 6, 4, timed=False)
