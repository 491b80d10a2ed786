"""Names and labels that hold one another, against all pairs."""

import random

import pytest

from memlake.operators import merge, search


def _names(rng, n):
    parts = ["the", "the tool", "Tool", "a", "ab", "", " ", None, "atlas", "the atlas of tools", "ATLAS", "x1", "x12", "x123", "é", "zé tool"]
    return [rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choice(["the", "to", "tool", "ol", "map", "b"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_projects(spark):
    rng = random.Random(5)
    new, old = list(enumerate(_names(rng, 120))), list(enumerate(_names(rng, 90)))
    clean = lambda s: (s or "").strip(" ").lower()
    want = {}
    for i, a in new:
        a = clean(a)
        fit = [j for j, b in old if a and clean(b) and (a == clean(b) or (min(len(a), len(clean(b))) >= 3 and (a in clean(b) or clean(b) in a)))]
        if fit:
            want[i] = min(fit)
    df = lambda rows: spark.createDataFrame(rows, "entry_id int, label string")
    got = merge.project_matches(df(new), df(old)).collect()
    assert {r["new_id"]: r["old_id"] for r in got} == want and len(got) == len(want)
    assert merge.project_matches(df([]), df(old)).count() == 0 and merge.project_matches(df(new), df([])).count() == 0


def test_labels(spark):
    rng = random.Random(6)
    plain = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split())
    asked, labels = list(enumerate(_names(rng, 80))), list(enumerate(_names(rng, 150)))
    want = set()
    for i, a in asked:
        for j, b in labels:
            a_, b_ = plain(a), plain(b)
            if a_ == b_:
                want.add((i, j, 1))
            elif a_ and a_ in b_:
                want.add((i, j, 2))
            elif a_ and all(w in b_ for w in a_.split()):
                want.add((i, j, 3))
    got = search.labels_matching(spark.createDataFrame(asked, "item_id int, asked string"), spark.createDataFrame(labels, "doc_id int, label string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {r for *_, r in want} == {1, 2, 3}


@pytest.mark.parametrize("hot", ["the same name", "the"])
def test_a_name_that_all_share(spark, hot):
    """50,000 projects of one name on both sides: names meet once."""
    same = spark.range(50_000).selectExpr("id entry_id", f"'{hot}' label")
    got = merge.project_matches(same, same)
    assert got.count() == 50_000 and [r[0] for r in got.select("old_id").distinct().collect()] == [0]
