import random
import re
from collections import Counter

from memlake.llm.quality import apply_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {j for i, g in enumerate(windows) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_measures_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a " * 9, "a " * 8, "x y " * 40, "é日😀 " * 30, "w" * 100000, "#|<>&*$% " * 25]
    for _ in range(150):
        part = " ".join(rng.choice(["the", "of", "ab", "c#", "é", "D|"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 40)))
        texts.append(rng.choice(["\n", " ", "\t "]).join([part] * rng.randint(1, 3) + [f"u{rng.random()}"] * rng.randint(0, 2)))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[-1], "x")], "doc_id long, text string, kept string")
    rows = apply_rules(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"]), repr(r["text"])[:80]
        assert not (r["base_failed"] and r["kept"])


def test_verdicts(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to"]) if i % 3 == 0 else "".join(rng.choice("abcdefgh") for _ in range(6)) for i in range(n))
    rows = [("clean", prose(60)), ("short", prose(10)), ("shout", prose(60).upper()), ("bullets", prose(60).replace(" ", " | ")), ("symbols", prose(60).replace(" ", "### ")), ("stutter", " ".join(w for w in prose(20).split() for _ in range(7)))]
    got = {r["doc_id"]: r["kept"] for r in apply_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"clean": True, "short": False, "shout": False, "bullets": False, "symbols": False, "stutter": False}
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_function_words_are_asked_of_their_languages_only(spark):
    rng = random.Random(3)
    made = lambda letters, n=40: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    russian, chinese, noise = made("абвгдежзиклмнопрст"), made("的一是不了人我在有他这为之大来"), made("bcdfghjkl")
    rows = [("russian", russian), ("chinese", chinese), ("names", russian + " Spark Hadoop"), ("noise", noise), ("mostly noise", noise + " " + made("абвг", 10)), ("french", "le chat et la souris " + noise), ("empty", "")]
    got = {r["doc_id"]: (r["fails_stop_words"], r["kept"]) for r in apply_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"russian": (False, True), "chinese": (False, True), "names": (False, True), "noise": (True, False), "mostly noise": (True, False), "french": (False, True), "empty": (False, False)}
