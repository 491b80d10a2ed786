import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from memlake.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["tree", "house", "river", "walks", "under", "green", "and", "the", "of", "light", "stone", "paper"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), "grubbel" + rng.choice(["a", "is", "ung", "ers"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_documents(spark):
    df = spark.createDataFrame(corpus(1200, 1), "doc_id long, text string, y int")
    model = tx.train(df, df.where("doc_id < 600").select("doc_id", df["y"].alias("toxic")))
    assert (np.diff(model.thresholds) > 0).all()
    got = tx.score(df, model).where("doc_id >= 600").collect()
    assert np.mean([r["toxic"] == bool(r["y"]) for r in got]) > 0.99
    many = [r["severity"] for r in got if r["text"].count("grubbel") >= 5]
    few = [r["severity"] for r in got if r["text"].count("grubbel") == 1]
    assert np.mean(many) > np.mean(few) + 0.3


def test_gradient_lowers_the_loss():
    rows = [tx.features(t) for _, t, _ in corpus(300, 2)]
    toxic = np.array([y for _, _, y in corpus(300, 2)])
    y, _ = tx.grades_of(rows, toxic)

    def loss(model):
        total = 0.0
        for (at, value), g in zip(rows, y):
            c = np.concatenate([[1], tx._sigmoid(model.weights[at] @ value - model.thresholds), [0]])
            total -= np.log(max(c[g] - c[g + 1], 1e-12))
        return total

    assert loss(tx.fit(rows, toxic, rounds=150)) < 0.7 * loss(tx.fit(rows, toxic, rounds=1))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "x " * 100000, "c")], "doc_id long, text string, severity string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.train(df, none)
    got = tx.score(df, model).collect()
    assert len(got) == 4 and not any(r["toxic"] for r in got)
    assert tx.score(df.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (9, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert tx.score(df, tx.train(df, odd)).count() == 4


def brute_severities(rows, labels):
    """The whole fit and score in plain loops over dictionaries."""
    toxic = {}
    for d, y in labels:
        if d is not None and y is not None:
            toxic[d] = max(y, toxic.get(d, 0))
    def told(text):
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for f in {tx._hash("w:" + w): 0, **{tx._hash(f"p{k}:" + w[:k]): 0 for k in tx.STEMS if len(w) > k}}:
                counts[f] += 1
        return {f: math.log1p(n) for f, n in counts.items()}

    all_rows = {}
    for d, t in rows:
        if d in toxic:
            all_rows[d] = min(t or "", all_rows.get(d, t or ""))
    sample = [(told(t), toxic[d]) for d, t in all_rows.items()]
    n = [sum(y == k for _, y in sample) for k in (0, 1)]
    seen = [Counter(f for x, y in sample if y == k for f in x) for k in (0, 1)]
    def ratio(f):
        total = 0.0
        for k in (0, 1):
            rate, own = (seen[0][f] + seen[1][f]) / sum(n), seen[k][f] / n[k]
            for many, p, q in ((seen[k][f], own, rate), (n[k] - seen[k][f], 1 - own, 1 - rate)):
                total += 2 * many * (math.log(max(p, 1e-12)) - math.log(max(q, 1e-12)))
        return total
    use = [f for f in set(seen[0]) | set(seen[1]) if seen[0][f] + seen[1][f] >= 3 and seen[1][f] / n[1] > seen[0][f] / n[0] and ratio(f) >= tx.EVIDENCE]
    load = [sum(v for f, v in x.items() if f in use) for x, _ in sample]
    edges = np.quantile([a for a, (_, y) in zip(load, sample) if y], np.arange(1, tx.GRADES) / tx.GRADES)
    grade = [1 + sum(e <= a for e in edges) if y else 0 for a, (_, y) in zip(load, sample)]
    above = [min(max(sum(g > k for g in grade) / len(grade), 1e-4), 1 - 1e-4) for k in range(tx.GRADES)]
    steps = [-math.log(a / (1 - a)) for a in above]
    theta = {**dict.fromkeys(use, 0.0), "t0": steps[0], **{f"t{k}": math.log(max(steps[k] - steps[k - 1], 1e-2)) for k in range(1, tx.GRADES)}}
    m, v = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    sig = lambda z: 1 / (1 + math.exp(-min(max(z, -40), 40)))
    def borders():
        out = [theta["t0"]]
        for k in range(1, tx.GRADES):
            out.append(out[-1] + math.exp(theta[f"t{k}"]))
        return out
    for step in range(1, 151):
        g, t = {f: 1e-4 * theta[f] if f in use else 0.0 for f in theta}, borders()
        for (x, _), y in zip(sample, grade):
            z = sum(value * theta[f] for f, value in x.items() if f in use)
            hi = sig(z - t[y - 1]) if y else 1.0
            lo = sig(z - t[y]) if y < tx.GRADES else 0.0
            p = max(hi - lo, 1e-12)
            a, b = hi * (1 - hi) / p / len(sample), lo * (1 - lo) / p / len(sample)
            for f, value in x.items():
                if f in use:
                    g[f] -= value * (a - b)
            for k, d in ((y - 1, a), (y, -b)):
                if 0 <= k < tx.GRADES:
                    g["t0"] += d
                    for j in range(1, k + 1):
                        g[f"t{j}"] += d * math.exp(theta[f"t{j}"])
        for f in theta:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.999 * v[f] + 0.001 * g[f] ** 2
            theta[f] -= 0.1 * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
    t = borders()
    return sorted((d, round(sum(sig(sum(x * theta[f] for f, x in told(text or "").items() if f in use) - b) for b in t), 4)) for d, text in rows)


def test_fit_and_score_equal_brute_force(spark):
    rows = [(i, t) for i, t, _ in corpus(160, 4)] + [(161, None), (162, "")]
    labels = [(i, y) for i, _, y in corpus(160, 4) if i < 100] + [(5, 0), (7, 1), (7, 0), (8, None), (None, 1), (999, 1), (161, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted((r["doc_id"], round(r["severity"], 4)) for r in tx.score(docs, model).collect())
    want = brute_severities(rows, labels)
    assert [d for d, _ in got] == [d for d, _ in want] and max(abs(a[1] - b[1]) for a, b in zip(got, want)) < 2e-3


def test_rows_that_share_a_key_do_not_lift_the_sample(spark):
    docs = spark.createDataFrame([(1, f"{i} tree") for i in range(500)] + [(2, "grubbel")], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, toxic int"), sample=2)
    assert len(model.thresholds) == tx.GRADES
