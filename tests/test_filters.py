"""Value scores, turn by turn, against scores of conversations joined as a whole."""

import random
import re

import regex

from memlake.operators import filters


def by_joining(turns, projects=()):
    """conv_id to the signals, from the texts joined in order."""
    has = lambda words, text: regex.search(filters.phrase(words), text, regex.A) is not None
    out = {}
    for conv in {t[0] for t in turns}:
        m = sorted(t[1:] for t in turns if t[0] == conv)
        lower = lambda rows: " ".join(x or "" for *_, x in rows).lower()
        t, u, last = lower(m), lower([r for r in m if r[1] == "user"]), m[-3:]
        signs = {
            "has_code": "```" in t, "decided": has(filters.DECISION, t), "learned": has(filters.LEARNING, u), "project": has(filters.PROJECT + projects, t),
            "repository": re.search(filters.REPOSITORY, t) is not None, "concluded": has(filters.CONCLUSION, lower(last)),
            "trouble": has(filters.TROUBLE, t) and not has(filters.DECISION, t) and not has(filters.CONCLUSION, t),
            "meta": has(filters.META, t) and len(regex.findall(filters.phrase(filters.AI_WORDS), t)) > 3 and len(m) < 6,
            "abandoned": len(m) >= 3 and all(r[1] == "assistant" for r in last),
        }
        out[conv] = signs | {"n_messages": len(m), "exchanges": min(sum(r[1] == role for r in m) for role in ("user", "assistant"))}
    return out


def test_turns_tell_what_joined_conversations_tell(spark):
    """Phrases cut between turns at any of their spaces, blank and empty turns within, texts that end or begin in part of
    a word of a phrase, and names far longer than what is looked back at."""
    rng = random.Random(11)
    fixed = [p for words in (filters.DECISION, filters.LEARNING, filters.CONCLUSION, filters.META) for x in words for p in x.split("|")]
    others = ["my tool project", "acme/" + "t" * 90 + " repo", "_x  repository", "w" * 80 + " codebase", "github.com/a/b", "```", "AI ai as an ai", "can you, ai, can you, ai, can you, ai", "big  thing", "error", "e/f", "Ünïcode project"]
    rows = []
    for conv in range(2500):
        pieces = []
        for _ in range(rng.randint(1, 7)):
            said = rng.choice([rng.choice(fixed), rng.choice(others), "plain words", "", " ", "\n", None, "a" * rng.randint(1, 60)])
            if said and rng.random() < 0.3:
                said = rng.choice("xq_. ") + said
            pieces += said.split(" ") if said and rng.random() < 0.7 else [said]
        # Words are joined again into turns, so that phrases are cut in places of their own.
        turns = []
        for p in pieces:
            if turns and p and turns[-1] and rng.random() < 0.3:
                turns[-1] += " " + p
            else:
                turns.append(p)
        for n, text in enumerate(turns):
            rows.append((conv, n // 2 if conv % 50 == 0 else n, rng.choice(["user", "assistant", "assistant", None]) if conv % 50 else rng.choice(["user", "assistant"]), text))
    rows = [r if r[2] is not None else (r[0], r[1], "tool", r[3]) for r in rows if not (r[0] % 50 == 0 and r[3] is None)]
    want = by_joining(rows, ("big  thing",))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(7)
    got = {r["conv_id"]: r.asDict() for r in filters.scored(df, projects=("big  thing",)).collect()}
    assert got.keys() == want.keys()
    for conv, signs in want.items():
        assert {k: got[conv][k] for k in signs} == signs, (conv, [r for r in rows if r[0] == conv])
    for name in ("decided", "learned", "project", "repository", "concluded", "trouble", "meta", "abandoned", "has_code"):
        assert 5 < sum(bool(s[name]) for s in want.values()) < 2490, name


def test_nulls_and_empty_tables(spark):
    schema = "conv_id int, turn int, role string, text string"
    assert filters.scored(spark.createDataFrame([], schema)).count() == 0
    row = filters.scored(spark.createDataFrame([(1, None, None, None)], schema)).collect()[0]
    assert (row["value_score"], row["decision"], row["skip_reason"], row["learned"], row["n_messages"]) == (0, "skip", "no_value_signals", False, 1)


def test_no_conversation_is_gathered(spark):
    """A conversation of 4 * 10^4 turns: one shuffle by conversation, and rows of bounded size."""
    df = spark.range(40_000).selectExpr("id div 1000000 conv_id", "id turn", "case when id % 2 = 0 then 'user' else 'assistant' end role", "case when id = 20000 then 'so I' when id = 20001 then 'decided' else repeat('y ', 100) end text")
    got = filters.scored(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r["n_messages"], r["exchanges"], r["decided"], r["value_score"]) for r in got.collect()] == [(40_000, 20_000, True, 6)]
