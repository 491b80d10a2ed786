import random
import time

from pyspark.sql import functions as F

from memlake.llm.line_dedup import _lines, _part, _reach, chunked, dedup
from tests.llm import brute


def prose(rng, lines):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) + (rng.choice([".", ",", ".\n", ";"]) if k % 6 == 5 else "") for k in range(6 * lines)).replace("\n ", "\n")


def test_passages_go_but_for_the_first(spark):
    rng = random.Random(1)
    passage = prose(rng, 14)
    rows, with_it = [], []
    for i in range(120):
        text = prose(rng, rng.randint(4, 30))
        if i % 6 == 0:
            text = text + " " + passage if rng.random() < 0.5 else prose(rng, 5) + "\n" + passage + "\n" + text
            with_it.append(i)
        rows.append((i, text, "x"))
    got = {r["doc_id"]: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string, removed_lines string")).collect()}
    words = len(passage.split())
    for i, text, _ in rows:
        lost = len(text.split()) - len(got[i]["text"].split())
        if i in with_it[1:]:
            assert 0.75 * words <= lost <= words, (i, lost, words)
        else:
            assert got[i]["text"] == text and got[i]["removed_lines"] == 0


def test_exact_copies_keep_one(spark):
    rng = random.Random(2)
    text = prose(rng, 40)
    got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")).collect()}
    assert got[0] == text and all(len(got[i]) < 0.15 * len(text) for i in range(1, 30))


def test_repeats_within_one_text(spark):
    rng = random.Random(3)
    part = prose(rng, 20)
    text = part + "\n" + part
    got = dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["text"].startswith(part[: len(part) // 2]) and len(got["text"]) < 1.35 * len(part)


def test_lines_rebuild_the_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ah .,\n;!é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", _lines(F.col("text")).alias("l")).collect()
    for r in rows:
        assert "".join(r["l"]) == r["text"] and r["l"] == brute.lines(r["text"])


def test_edges(spark):
    rows = [(None, None), (None, None), (1, ""), (2, "\n\n"), (2, "short line."), (2, "short line."), (3, "word " * 60000)]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_passage_of_over_50_words_goes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, passages = [], []
    for clauses in range(1, 21):
        for _ in range(10):
            words = [word() for _ in range(rng.randint(51, 120))]
            for at in rng.sample(range(len(words)), clauses - 1):
                words[at] += rng.choice(".,;:!?")
            passages.append(words)
            for _ in range(3):
                rows.append((len(rows), " ".join([word() for _ in range(rng.randint(0, 60))] + words + [word() for _ in range(rng.randint(0, 60))])))
    got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        lost = len(text.split()) - len(got[i].split())
        assert lost == (len(passages[i // 3]) if i % 3 else 0), (i, lost)


def test_space_is_compared(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    rows = [(1, " ".join(words)), (2, "\n".join(words)), (3, " ".join(words[:60])), (4, "x\n" + " ".join(words[5:]))]
    got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: "x"}


def test_short_repeats_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    phrase = " ".join(word() for _ in range(30))
    rows = [(i, " ".join([word() for _ in range(40)] + [phrase] + [word() for _ in range(40)])) for i in range(20)]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows


def test_a_very_long_repeated_text(spark):
    rng = random.Random(8)
    text = "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(5)) for _ in range(200_000))
    began = time.time()
    got = {r["doc_id"]: r["removed_chars"] for r in dedup(spark.createDataFrame([(1, text), (2, text), (3, "own")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: len(text), 3: 0} and time.time() - began < 120


def test_chunks_need_no_sort_and_no_bytes(spark):
    docs = spark.createDataFrame([(1, 2, "some text")], "__k long, __t long, text string")
    plan = chunked(docs)._jdf.queryExecution().analyzed().toString()
    assert "array_sort" not in plan and "array_join" not in plan


def test_chunks_are_those_of_brute_force(spark):
    rng = random.Random(9)
    texts = [rng.choice(["", "\n", " "]).join(rng.choice(["same", "same.", "a b.", "\n", "x, y", prose(rng, 1)]) + rng.choice([" ", "\n", " \t"]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "__k long, text string").withColumn("__t", F.lit(0))
    got = {}
    for r in chunked(rows).collect():
        got.setdefault(r["k"], []).append((r["s"], r["g"]))
    for k, text in enumerate(texts):
        starts = brute.chunk_starts(brute.lines(text))
        assert sorted(got.get(k, [])) == [(s, e - s if e else 0) for s, e in zip(starts, starts[1:] + [None])], k


def test_common_words_of_lines(spark):
    rng = random.Random(10)
    line = lambda: "".join(rng.choice(["a", "b", "é", " ", "\t"]) for _ in range(rng.randint(1, 5)))
    pairs = [(line(), line()) for _ in range(400)] + [("a ", "b\t"), ("\n", "\n a"), ("a", None)]
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", _part(F.col("x"), F.col("y"), False).alias("top"), _part(F.col("x"), F.col("y"), True).alias("end"))
    for r in got.collect():
        a, b = ([], []) if r["y"] is None else (brute._bare(r["x"]), brute._bare(r["y"]))
        assert (r["top"], r["end"]) == (brute._same(a, b), brute._same(a[::-1], b[::-1])), r


def test_reach_is_that_of_all_before_or_after(spark):
    rng = random.Random(11)
    # As bounds are: each within some lines of its place.
    rows = [([i + rng.choice([0, 0, rng.randint(0, 5)]) for i in range(rng.randint(0, 30))],) for _ in range(100)] + [([1, 2, 3],)]
    got = spark.createDataFrame(rows, "v array<long>").select("v", _reach(F.col("v"), True).alias("low"), _reach(F.col("v"), False).alias("high")).collect()
    for r in got:
        n = len(r["v"])
        assert r["low"] == [min(r["v"][i:]) for i in range(n)] and r["high"] == [max(r["v"][: i + 1]) for i in range(n)]


def test_few_words_on_many_lines_and_words_at_both_ends(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    blank = ["".join(word() + "\n" * 2 for _ in range(n)) for n in (30, 45)]
    p, q = (" ".join(word() for _ in range(70)) for _ in range(2))
    rows = [(0, blank[0]), (1, blank[1]), (2, blank[0]), (3, blank[1]), (4, p + " \n" + q), (5, q + " " + p)]
    for i in range(6, 40):
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 3))] + [p] + [word() for _ in range(rng.randint(0, 3))] + [q] + [word() for _ in range(rng.randint(0, 3))])))
    got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute.line_dedup(rows)
    assert got[2] == blank[0] and got[3] != blank[1]
