"""Pairs of views made block by block, against plain loops; labels of very many views with long texts."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake import policy as P
from memlake.operators import replay
from memlake.plans import overlaps
from memlake.queries import QUERIES
from memlake import queries_merge  # noqa: F401  registers contested_entries

ENTRY = "entry_id long, entry_type string, label string, narrative string, confidence string"


def said(kind, a, b):
    """(near, compatible, reason) of two views (narrative, low), or None for what is not known."""
    one, two = set(a[0].split()), set(b[0].split())
    near = len(one & two) / len(one | two) if one and two else 0.0
    blank, against, reason = not one or not two, None, None
    if not blank and kind not in ("project", None):
        against = next((f"opposing markers ({p} vs {n})" for p, n in P.OPPOSING if (p in a[0] and n in b[0]) or (n in a[0] and p in b[0])), None)
        reason = against or (f"same topic has materially different views (similarity={near:.2f})" if near <= P.CONTRADICTION_SIMILARITY and not a[1] and not b[1] else None)
    alike = blank or (not against and (near >= P.COMPATIBLE_SIMILARITY or a[0] in b[0] or b[0] in a[0]))
    return near, True if kind == "project" or alike else None if kind is None else False, reason


def by_loop(rows):
    views = {}
    for i, kind, label, text, confidence in rows:
        key = (kind, label, text, confidence == "low")
        views[key] = min(views.get(key, i), i)
    out = []
    for (kind, label, *a), i in views.items():
        for (other, its, *b), j in views.items():
            if (kind, label) == (other, its) and a < b:
                out.append((f"{kind}:{label}" if kind else label, i, j, *said(kind, a, b)))
    return sorted(out)


def some_rows():
    rng = random.Random(11)
    words, rows = [f"w{i}" for i in range(60)], []
    for label in range(40):
        kind = rng.choice(["project", "knowledge", "knowledge", "knowledge", None])
        for _ in range(rng.choice([1, 2, 5, 40])):
            text = rng.sample(words, rng.choice([0, 1, 2, 4, 30]))
            if rng.random() < 0.3:
                text.append(rng.choice(["outperform", "underperform", "rising", "falling", "buy", "sell"]))
            rows.append((len(rows), kind, f"label {label}", " ".join(text), rng.choice(["high", "high", "low"])))
    for i in rng.sample(range(len(rows)), 60):  # texts within others, some in the midst of words
        _, kind, label, text, sure = rows[i]
        rows.append((len(rows), kind, label, f"more x{text}y and then {' '.join(rng.sample(words, 20))}", sure))
        rows.append((len(rows), kind, label, text, sure))
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_pairs_equal_loops(spark, monkeypatch, block):
    monkeypatch.setattr(overlaps, "BLOCK", block)
    rows = some_rows()
    want = by_loop(rows)
    df = spark.createDataFrame(rows, ENTRY).repartition(3)
    got = sorted(map(tuple, replay.view_pairs(df).collect()))
    assert got == want
    assert {r[4] for r in want} == {True, False, None} and len({r[5] for r in want}) > 5
    conflicts, reasons = {}, {}
    for _, a, b, _, _, reason in want:
        if reason:
            for i, j in ((a, b), (b, a)):
                conflicts.setdefault(i, set()).add(j)
                reasons.setdefault(i, set()).add(reason)
    for found in (replay.contradictions(df), replay.rolled_up(replay.view_pairs(df))):
        assert {r["entry_id"]: (r["reasons"], r["conflicts"]) for r in found.collect()} == {i: (sorted(reasons[i]), sorted(conflicts[i])) for i in conflicts}


def test_marked_keeps_repeated_entries_and_old_links(spark):
    link = "array<struct<knowledge_id:long,relationship:string>>"
    rows = [(1, "knowledge", "one topic", "a b c", "high"), (1, "knowledge", "one topic", "a b c", "high"), (2, "knowledge", "one topic", "d e f", "high"), (3, "knowledge", "other topic", "d e f", "high")]
    df = spark.createDataFrame(rows, ENTRY).withColumns({"state": F.lit("active"), "links": F.expr(f"case when entry_id = 2 then array(named_struct('knowledge_id', 3L, 'relationship', 'supports')) when entry_id = 3 then cast(array() as {link}) end")})
    for found in (replay.contradictions(df), replay.view_pairs(df)):
        got = sorted((r["entry_id"], r["state"], r["links"]) for r in replay.marked(df, found).collect())
        assert got == [(1, "contested", [(2, "contradicts")])] * 2 + [(2, "contested", [(3, "supports"), (1, "contradicts")]), (3, "active", [])]


@pytest.mark.parametrize("limits", [(200, 4096, 2_000_000), (1, 4096, 10), (10**9, 3, 10), (10, 5, 1)])
def test_words_in_common_equal_sets(monkeypatch, limits):
    for name, x in zip(("DENSE", "COLUMNS", "MATCHES"), limits, strict=True):
        monkeypatch.setattr(overlaps, name, x)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(30)], k=rng.choice([0, 1, 9, 40]))) for _ in range(70)]
    words = overlaps.Words(pa.array(texts))
    for a, b in ((range(70), range(70)), (range(0, 70, 2), range(1, 70, 2)), (range(3), range(60, 61))):
        want = [[len(set(texts[x].split()) & set(texts[y].split())) for y in b] for x in a]
        assert overlaps.common(words, np.array(a), np.array(b)).tolist() == want


def test_hundredths_are_those_that_are_written():
    near = np.array(sorted({p / q for q in range(1, 1001) for p in range(q // 8 + 1) if p / q <= P.CONTRADICTION_SIMILARITY}))
    assert [replay.REASONS[k + 1 + len(P.OPPOSING)][-5:-1] for k in np.searchsorted(replay.EDGES, near, "right")] == [f"{x:.2f}" for x in near]


def documents(spark, path, texts):
    df = spark.createDataFrame([(4 * (5 * i + 1), t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_near_is_rounded_as_sql_does(spark, tmp_path):
    """41 of 640 words: 0.0640625, of which SQL makes 0.064062."""
    label = " ".join(f"label{i:05}" for i in range(6))
    texts = [" ".join([label, *[f"c{i}" for i in range(35)], *[f"{x}{i}" for i in range(n)]]) for x, n in (("a", 300), ("b", 299))]
    row = QUERIES["view_pairs"](spark, documents(spark, tmp_path, texts)).first()
    assert row["near"] == 0.064062


@pytest.fixture(scope="module")
def one_label(spark, tmp_path_factory):
    """2,500 long texts that begin alike: 3 million pairs of some 300 words."""
    rng = np.random.default_rng(5)
    label = " ".join(f"label{i:05}" for i in range(6))
    texts = [label + " " + " ".join(f"w{x}" for x in rng.zipf(1.2, rng.integers(300, 800)) % 50_000) for _ in range(2500)]
    sets = [set(t.split()) for t in texts]
    column = {w: k for k, w in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[w] for w in s]] = 1
    both, size = (m @ m.T).astype(float), m.sum(1).astype(float)
    near = both / (size[:, None] + size[None, :] - both)
    assert 0.05 < (near <= P.CONTRADICTION_SIMILARITY).mean() < 0.95
    return documents(spark, tmp_path_factory.mktemp("one") / "label", texts), near


@pytest.mark.parametrize("name", ["contested_entries", "contradiction_plans", "view_pairs"])
def test_a_label_of_many_long_views(spark, one_label, name):
    path, near = one_label
    began = time.time()
    df = QUERIES[name](spark, path)
    if name == "view_pairs":
        got = df.agg(F.count(F.lit(1)), F.sum("near"), F.count_if("compatible"), F.count("reason")).first()
        upper = near[np.triu_indices(len(near), 1)]
        assert (got[0], got[2], got[3]) == (len(upper), (upper >= P.COMPATIBLE_SIMILARITY).sum(), (upper <= P.CONTRADICTION_SIMILARITY).sum())
        assert abs(got[1] - upper.sum()) < 1e-6 * len(upper)
    else:
        column = "links" if name == "contested_entries" else "conflicts"
        got = {r["entry_id"]: r[column] for r in df.select("entry_id", column).collect()}
        against = (near <= P.CONTRADICTION_SIMILARITY) & ~np.eye(len(near), dtype=bool)
        want = {4 * (5 * i + 1): ",".join(str(4 * (5 * int(k) + 1)) for k in np.flatnonzero(row)) for i, row in enumerate(against)}
        assert {i: x for i, x in got.items() if x} == {i: x for i, x in want.items() if x}
    assert time.time() - began < 60
