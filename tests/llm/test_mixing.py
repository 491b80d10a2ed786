import random
import re

import pytest

from memlake.llm.mixing import mix, sainte_lague, sizes, taken_texts

WORD = r"[^\x20\x09-\x0D]+"


def goals(by_source):
    """The contract's rule: deal by weight, stop at twice the size, deal the excess again until none is above."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(by_source.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by_source[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * by_source[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takings(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z1", "z2", None, ""][: rng.randint(2, 7)]
    rows = [(i, rng.choice(names + names[:1] * 4), rng.choice([0, 1, rng.randint(5, 400)])) for i in range(3000)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, size long, taken int").drop("taken")
    got = mix(df, shard_docs=200).collect()
    assert len(got) == len(rows)
    by = {}
    for _, s, n in rows:
        by[s] = by.get(s, 0) + n
    want = goals(by)
    for s in by:
        of = [r for r in got if r["source"] == s]
        assert of[0]["source_size"] == by[s] and of[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in of) - want[s]) <= max(0.02 * want[s], 64)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mix(df.orderBy("size"), shard_docs=200).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def brute_seats(votes, house):
    seats = dict.fromkeys(votes, 0)
    for _ in range(house):
        best = min((i for i in votes if votes[i]), key=lambda i: (-votes[i] / (2 * seats[i] + 1), i))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("seed", range(4))
def test_quotas_equal_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = {i: rng.choice([0, rng.randint(1, 50), rng.randint(1, 10**6)]) for i in range(rng.randint(1, 40))}
    votes[0] = 7
    house = rng.randint(0, 300)
    df = spark.createDataFrame([(i, float(v), house) for i, v in votes.items()], "id long, votes double, house long")
    assert {r["id"]: r["seats"] for r in sainte_lague(df, "house").collect()} == brute_seats(votes, house)


def test_texts_hold_the_words_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randint(0, 90))), rng.choice(["a", "b", None]), "k") for i in range(300)]
    rows += [(1, None, "a", "k"), (2, "", "b", "k"), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, picks string")
    words = sum(len(re.findall(WORD, r["text"])) for r in taken_texts(df).collect())
    assert words == sum(r["taken"] for r in mix(sizes(df)).collect()) > 0
    assert taken_texts(df).columns == df.columns


def test_nothing_to_mix(spark):
    kind = "doc_id long, source string, size long"
    assert mix(spark.createDataFrame([], kind)).count() == 0
    got = mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], kind)).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_a_tiny_source_changes_no_other(spark):
    rows = [(i, "big", 1000) for i in range(2000)]
    kind = "doc_id long, source string, size long"
    alone = mix(spark.createDataFrame(rows, kind)).collect()
    got = mix(spark.createDataFrame([*rows, (-1, "tiny", 3)], kind)).collect()
    assert max(len(r["picks"]) for r in got) <= max(len(r["picks"]) for r in alone) <= 18
    tiny = [r for r in got if r["source"] == "tiny"]
    assert tiny[0]["taken"] == tiny[0]["target"] > 0


def test_documents_without_an_id_spread_over_shards(spark):
    rows = [(None, f"w{i} x y", "a", "k") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k string")
    got = mix(sizes(df), shard_docs=20).collect()
    assert 0.9 * 1.5 * 1200 <= sum(r["taken"] for r in got) <= 1.1 * 1.5 * 1200
