"""Primary paths by jumping: random trees against a plain walk, long chains, and parents in a circle."""

import random

from memlake.operators import parse

NODES = "conv_id long, id string, parent_id string, ord int, created_at string"


def greedy(nodes):
    """Ids from the first root down, at each fork into the branch with the latest leaf, the first on ties."""
    kids = {}
    for n in sorted(nodes, key=lambda n: (n[3], n[1])):
        kids.setdefault(n[2], []).append(n)
    latest = {}

    def leaf(n):
        if n[1] not in latest:
            latest[n[1]] = max(leaf(c) for c in kids[n[1]]) if n[1] in kids else (n[4] is not None, n[4] or "")
        return latest[n[1]]

    known = {n[1] for n in nodes}
    roots = kids.get(None) or sorted((n for n in nodes if n[2] not in known), key=lambda n: (n[3], n[1]))
    at, path = roots[0] if roots else None, []
    while at:
        path.append(at[1])
        below = kids.get(at[1], [])
        at = max(below, key=lambda c: (leaf(c), -c[3])) if below else None
    return path


def test_random_trees_and_cycles(spark):
    rng = random.Random(11)
    rows, want, circles = [], {}, []
    for conv in range(80):
        n = rng.randint(1, 25)
        nodes = [(conv, "n0", rng.choice([None, "gone"]), 0, rng.choice([None, "t3"]))]
        nodes += [(conv, f"n{i}", f"n{rng.randrange(max(0, i - 4), i)}", i, rng.choice([None, "t0", "t1", "t2"])) for i in range(1, n)]
        if conv % 3 == 0:
            nodes += [(conv, "x", "y", 90, "t9"), (conv, "y", "x", 91, "t9"), (conv, "z", "x", 92, "t9"), (conv, "own", "own", 93, "t9")]
            circles += [(conv, i) for i in ("own", "x", "y", "z")]
        want[conv] = greedy([x for x in nodes if (x[0], x[1]) not in circles])
        rows += nodes + rng.sample(nodes, 1)
    rows += [(100, "a", "b", 0, "t"), (100, "b", "a", 1, "t")]
    circles += [(100, "a"), (100, "b")]
    df = spark.createDataFrame(rows, NODES)
    walked = parse.tour(df)
    assert sorted(map(tuple, parse.cyclic_nodes(walked).collect())) == sorted(circles)
    got = {}
    for r in parse.primary_messages(walked).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append(r["id"])
    assert got == want
    assert {r["conv_id"]: r["path"] for r in parse.primary_path(df).collect()} == want
    turns = parse.primary_messages(walked).groupBy("conv_id").agg({"turn": "max", "id": "count"}).collect()
    assert all(r["max(turn)"] + 1 == r["count(id)"] for r in turns)


def test_a_long_chain_beside_short_ones(spark):
    """10^5 messages one below the other: 18 rounds, no row ever larger than another."""
    n = 100_000
    rows = spark.range(n).selectExpr("1L as conv_id", "concat('m', id) as id", "case when id > 0 then concat('m', id - 1) end as parent_id", "cast(id as int) as ord", "cast(null as string) as created_at")
    rows = rows.unionByName(spark.createDataFrame([(2, "a", None, 0, None)], NODES))
    got = parse.primary_messages(parse.tour(rows))
    assert got.where("conv_id = 1").selectExpr("count(*)", "count_if(id = concat('m', turn))", "max(turn)").first() == (n, n, n - 1)
    assert [tuple(r) for r in got.where("conv_id = 2").collect()] == [(2, 0, "a")]


def test_no_nodes(spark):
    assert parse.primary_path(spark.createDataFrame([], NODES)).count() == 0
