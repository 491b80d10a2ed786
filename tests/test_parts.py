"""Matching with hot keys, a store in parts, and runs counted in flight."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from memlake.operators import merge
from memlake.sources import store

ENTRY = "entry_id long, label string, repos array<string>, embedding array<double>"


def words(label):
    return {w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in (label or "").lower()).split()}


def brute(new, old, near):
    out = {}
    for i, label, repos, v in new:
        found = []
        for j, other, theirs, w in old:
            size = (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5
            cos = sum(x * y for x, y in zip(v, w)) / size if size else 0.0
            n = (len(words(label) & words(other)) >= 2) + bool({r.lower() for r in repos or []} & {r.lower() for r in theirs or []}) + (cos > near)
            if n >= 2 and cos > 0:
                found.append((-round(cos, 9), j, n))
        if found:
            out[i] = min(found)
    return out


@pytest.mark.parametrize("pairs,rows", [(10**9, 4096), (40, 7), (0, 3)])
def test_matches_whatever_is_hot(spark, pairs, rows):
    rng = random.Random(7)
    pool = ["the", "plan", "of", "blue", "green", "red", "alpha", "beta"]
    make = lambda i: (i, " ".join(rng.sample(pool, rng.randint(0, 4))), rng.choice([None, [], ["Acme/x"], ["acme/X", "b"], [f"r{rng.randrange(5)}"]]), [rng.gauss(0, 1) for _ in range(4)] if rng.random() < 0.95 else [0.0] * 4)
    new, old = [make(i) for i in range(60)], [make(1000 + i) for i in range(90)]
    found = merge.matches(spark.createDataFrame(new, ENTRY), spark.createDataFrame(old, ENTRY), 0.6, pairs, rows)
    assert {r["new_id"]: (-round(r["similarity"], 9), r["old_id"], r["signals"]) for r in found.collect()} == brute(new, old, 0.6)


def test_one_repository_and_word_pair_of_all_entries(spark):
    """3,000 new and 12,000 stored entries share a repository and two words: 36 million pairs, of which no rows are made."""
    side = lambda n, at: spark.range(n).selectExpr(f"id + {at} as entry_id", "concat('common words x', id) as label", "array('acme/all') as repos", "array(cast(id % 97 as double), cast(id % 89 as double), 1.0D) as embedding")
    began = time.time()
    found = merge.matches(side(3000, 0), side(12000, 100_000))
    assert found.count() == 3000 and time.time() - began < 120


def test_a_store_in_parts(spark, tmp_path):
    root = str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame(rows, "entry_id string, entry_type string, n int")
    store.create_parts(frame([(f"e{i}", "knowledge", 0) for i in range(400)]), root, parts=16)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/parts") for f in names if f.endswith(".parquet")}
    before, one = files(), store.read_parts(spark, root)
    assert store.upsert_parts(frame([("e1", "knowledge", 1), ("e2", "knowledge", 1), ("new", "project", 1)]), root) == 2
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) <= 3
    # The version before is read whole while the next is there.
    assert one.agg(F.count("*"), F.sum("n")).first() == (400, 0)
    assert store.read_parts(spark, root).agg(F.count("*"), F.sum("n")).first() == (401, 3)
    assert store.read_parts(spark, root, 1).count() == 400
    # A version that stops before its manifest is not seen, and is written over by the next.
    frame([("e1", "lost", 9)]).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{root}/parts/written=3")
    assert store.read_parts(spark, root).count() == 401
    assert store.upsert_parts(frame([("e9", "knowledge", 5)]), root) == 3 and store.upsert_parts(frame([]), root) == 3
    assert store.read_parts(spark, root).agg(F.count("*"), F.sum("n")).first() == (401, 8)
    with pytest.raises(ValueError):
        store.read_parts(spark, root, 9)
    empty = str(tmp_path / "e")
    store.create_parts(frame([]), empty, parts=4)
    assert store.read_parts(spark, empty).count() == 0 and store.upsert_parts(frame([("a", "b", 1)]), empty) == 2
    assert store.read_parts(spark, empty).count() == 1
