import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import ngram_join as nj


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 12, 40, 150]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [word() for _ in range(rng.randint(0, 2))]
            rows.append(rng.choice([" ", "\n", " \t "]).join(copy))
    rows += ["", None, "   \n", "one", "One", "ONE two", "one two", "hot copy of the same text"] + ["hot copy of THE same text"] * 60
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_links string")
    got = nj.join(df)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)
    kept = sorted(r["doc_id"] for r in nj.one_of_each(df).collect())
    assert kept == sorted(d for d, _, c in brute(rows) if d == c)


def test_long_chains_are_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 300)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(-(2**62), 2**62, rng.integers(5, 400))) for _ in range(40)]
    sets = []
    for b in base:
        for _ in range(8):
            drop = rng.random(len(b)) < rng.choice([0.02, 0.1, 0.14, 0.2])
            sets.append(np.unique(np.concatenate([b[~drop], rng.integers(-(2**62), 2**62, int(rng.integers(0, max(1, len(b) // 10) + 1)))])))
    order = np.argsort([len(s) for s in sets], kind="stable")
    tree = nj.SignatureTree(sets, order, np.arange(len(sets)))
    told = {tuple(sorted((int(order[p]), int(order[q])))) for p, q in tree.pairs()}
    all_links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if nj.linked(sets[i], sets[j])}
    assert all_links and all_links <= told and len(told) < len(sets) * len(sets) / 4
    groups = defaultdict(set)
    forest = nj.Forest(len(sets))
    for i, j in nj.spanning_links(sets):
        forest.up[forest.root(i)] = forest.root(j)
    assert all(forest.root(i) == forest.root(j) for i, j in all_links)


def test_empty_null_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (5, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in nj.join(df).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("5", 0, 5), ("None", 0, None), ("None", 2, 3)]
    assert nj.join(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in nj.one_of_each(df).collect()) == [-1, 3, 5]


def test_sets_do_not_depend_on_batches():
    texts = ["a B c d e f g", None, "x", "", "é " * 50 + "q"] * 3
    whole = nj.shingle_sets(pa.array(texts, pa.string()))
    for t, s in zip(texts, whole):
        assert nj.shingle_sets(pa.array([t], pa.string()))[0].tolist() == s.tolist()
    assert nj.shingle_sets(pa.array(texts, pa.string()).slice(4, 3))[0].tolist() == whole[4].tolist()


@pytest.mark.parametrize("most", [3_000_000, 300])
def test_every_link_is_counted(spark, monkeypatch, most):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", most)
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(80)]
    near = [" ".join(w if k != i else "other" for k, w in enumerate(base)) for i in range(3, 40)]
    rows = corpus(4) + [(1000 + i, t) for i, t in enumerate(near + near[:5])]
    sets = [set(s.tolist()) for s in nj.shingle_sets(pa.array([t for _, t in rows], pa.string()))]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    want = {d: sum(linked(sets[i], sets[j]) for j in range(len(rows)) if j != i) for i, (d, _) in enumerate(rows)}
    got = {r["doc_id"]: r["n_links"] for r in nj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and max(want[1000 + i] for i in range(42)) == 41


def test_null_and_repeated_keys_lose_no_document(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(20))
    rows = [(None, text("a"), 1), (None, text("b"), 1), (7, text("c"), 1), (7, text("d"), 1), (7, text("d"), 2), (9, text("d") + " x", 1), (None, None, 1), (None, None, 2)]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect())
    assert got == [("7", text("c")), ("7", text("d")), ("None", ""), ("None", ""), ("None", text("a")), ("None", text("b"))]


def test_a_join_takes_over_from_the_filter(spark, monkeypatch):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nj, "BITS_EACH", 1 << 40)
    assert sorted(map(tuple, nj.join(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)
