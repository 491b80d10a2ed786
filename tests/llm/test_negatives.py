import math
import random

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import negatives as N


def brute(rows):
    """Result rows of (vec_id, vector, label), by the words of the contract."""
    use = []
    for at, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, label, a in use:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j is None, j or 0, other, j, kind) for other, j, kind, b in use if other != at)
        for p in [s for s in scored if s[5] == label][:5]:
            good = [s for s in scored if s[5] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, p[4], r + 1, s[4], -p[0], -s[0]) for r, s in enumerate(good)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, row int, at string")


def exact(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(4)) for i in range(0, 900, 3)]
    rows += [(i, rows[5][1], rng.randrange(3)) for i in range(901, 1000)] + [(300, rows[5][1], 1), (None, rows[5][1], 1), (None, rows[6][1], 2)]
    rows += [(1000, None, 1), (1100, [0.1] * 12, None), (1200, [float("nan")] * 12, 1), (1300, [float("inf")] + [0.0] * 11, 1), (1400, [None] * 12, 1), (1500, [], 1), (1600, [0.5] * 3, 2), (-700, [1.0] * 15, 3), (1700, [0.0] * 12, 9)]
    df = frame(spark, rows).coalesce(1)
    keep = N.TREE, N.HELD, N.BOUNDED
    try:
        for tree, held, bounded in (keep, (3, 12 * 50, 16)):
            N.HELD, N.BOUNDED = held, bounded
            prepared = N.prepared(df)
            anchors = prepared.where("vec_id % 100 = 0")
            given = N.trees
            N.trees = lambda a: given(a, tree)  # noqa: B023
            got = sorted((tuple(r) for r in N.hard_negatives(prepared, anchors).collect()), key=repr)
            N.trees = given
            assert got == brute(exact(df)) and len(got) > 100
    finally:
        N.TREE, N.HELD, N.BOUNDED = keep


def test_empty_and_negative_scores(spark):
    df = frame(spark, [(100, [1.0, 0.0], 1), (101, [-1.0, 0.0], 1), (102, [-0.9, 0.0], 2)])
    rows = N.prepared(df)
    assert N.hard_negatives(rows, rows.where("vec_id % 100 = 0")).count() == 0
    assert N.hard_negatives(rows, rows.where("false")).count() == 0 and N.hard_negatives(rows.where("false"), rows.where("false")).count() == 0


def test_large_components_are_exact(spark):
    df = spark.createDataFrame([(100, [3e6, 1.0], 1), (101, [3e6 + 2**-8, 7.0], 1), (102, [3e6, 5.0], 2), (103, [3e6, 6.0], 2)], "vec_id long, embedding array<double>, label int")
    rows = N.prepared(df)
    got = sorted(tuple(r) for r in N.hard_negatives(rows, rows.where("vec_id = 100")).collect())
    assert got == sorted(brute([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])) and len(got) == 2


def test_bounds_hold_and_save_work():
    """Along the tree every score lies within its bounds, and near clusters leave most candidates unscored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (20, 32))
    anchors, points = (np.floor(centres[rng.integers(0, 20, n)] + rng.normal(0, 5, (n, 32))) for n in (100, 4000))
    order, parent, edge = N.spanning_tree(anchors)
    assert parent[0] == -1 and (parent[1:] < np.arange(1, 100)).all() and (parent[1:] >= 0).all()
    a = anchors[order]
    assert np.allclose(edge[1:], np.linalg.norm(a[1:] - a[parent[1:]], axis=1))
    norm = np.linalg.norm(points, axis=1)
    held = {"points": points, "norm": norm, "row": np.arange(4000), "label": np.zeros(4000, int), "rank": np.arange(4000)}
    tree = {"points": a, "parent": parent, "edge": edge, "row": np.arange(9000, 9100), "label": np.ones(100, int)}
    whole = a @ points.T
    windows = [[N.Found(int(0.9 * t), int(t), 5)] for t in np.sort(whole, axis=1)[:, -50]]
    told = []
    N.search_tree(tree, held, windows, False, told)
    for scores, (w,) in zip(whole, windows):
        fits = np.flatnonzero((scores >= w.low) & (scores <= w.high))
        best = fits[np.lexsort((fits, -scores[fits]))][:5]
        assert list(w.pick) == list(best)
    asked, all_of = (sum(x) for x in zip(*told))
    assert asked < 0.5 * all_of
