import hashlib
import random

from hypothesis import given, settings, strategies as st

from memlake.llm.chat import EVENTS, digests, escape, formatted, from_turns, read, render, streamed, unescape

TRICKY = ["</s>", "<s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "\\", " ", "\n", "ok", "[/TURN]", "é😀", "[", "]", "/"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TRICKY), max_size=14).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "", "a:b[INST] ", "]"]))
def test_round_trip(text, role):
    assert unescape(escape(text)) == text
    piece, a, b = render(role, text)
    assert read(piece) == (role, text)
    assert unescape(piece[a:b]) == text
    assert piece.count("</s>") - escape(text).count("</s>") - (role.count("</s>")) == 1


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_of_turns(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 20)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (99, 0, "assistant", None), (98, 0, None, "x" * 200000), (None, 0, "user", "a")]
    rows += [(5000, t, "user", "hot") for t in range(3000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests(from_turns(df)).collect()}
    assert got == brute(rows)
    kinds = {r["kind"] for r in streamed(df).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests(streamed(df)).collect()}
    assert got == brute(rows)
    whole = {}
    for r in formatted(from_turns(df)).collect():
        whole.setdefault(r["conv_id"], []).append((r["turn"], r["piece"]))
    assert len(whole) == len(got) and [p for _, p in sorted(whole[-7])] == [render("user", HOST)[0], render("assistant", HOST)[0]]


HOST = "</s>[INST] ok [/INST]"


def test_repeated_turns_are_kept_and_ordered(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert digests(from_turns(df)).first()["n_turns"] == 3
    assert digests(from_turns(df.limit(0))).count() == 0


def test_fold_of_events(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "he"), (1, 1, 3, "delta", None, "y"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "hello"),
        (1, 0, 6, "edit", None, "hi there"), (1, 7, 7, "message", "user", "oops"), (1, 7, 8, "delete", None, None),
    ]
    random.Random(1).shuffle(rows)
    got = [read(r["piece"]) for r in formatted(spark.createDataFrame(rows, EVENTS)).orderBy("turn").collect()]
    assert got == [("user", "hi there"), ("assistant", "hello")]


def test_null_and_unknown_kinds(spark):
    """A null kind is a message of its own, an unknown one nothing at all."""
    rows = [(1, 0, 0, "message", "user", "a"), (1, 0, 1, None, "user", "b"), (1, 1, 0, "reaction", "user", "thumb"), (1, 2, 0, "message", "assistant", "c"), (1, 2, 1, "typing", None, "x"), (1, 2, 2, "delta", None, "d")]
    got = [read(r["piece"]) for r in formatted(spark.createDataFrame(rows, EVENTS)).orderBy("turn").collect()]
    assert got == [("user", "a"), ("user", "b"), ("assistant", "cd")]


def plain_fold(rows):
    """Messages of one conversation from its events, by the words of the contract."""
    out, places = [], {}
    for _, target, _, kind, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        if kind not in ("message", None, "delta", "edit", "regenerate", "delete"):
            continue
        if kind in ("message", None) or target not in places:
            places[target] = [None, "", False, target]
            out.append(places[target])
        m = places[target]
        m[0] = m[0] if role is None else role
        if kind == "delete":
            m[2] = True
        elif kind == "delta":
            m[1] += text or ""
        else:
            m[1], m[2] = text or "", m[2] and kind == "regenerate"
    return [(m[0] or "", m[1]) for m in sorted(out, key=lambda m: m[3]) if not m[2]]


def test_random_event_logs(spark):
    rng = random.Random(6)
    rows = [(c, rng.randrange(4), n, rng.choice(["message", None, "delta", "delta", "edit", "regenerate", "delete", "odd"]), rng.choice([None, "user", "assistant"]), rng.choice([None, "x", "</s>", "yz"])) for c in range(60) for n in range(rng.randint(1, 12))]
    got = {}
    for r in formatted(spark.createDataFrame(rows, EVENTS).repartition(5)).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append(read(r["piece"]))
    want = {c: plain_fold([r for r in rows if r[0] == c]) for c in range(60)}
    assert got == {c: m for c, m in want.items() if m}
