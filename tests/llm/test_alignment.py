import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from memlake.llm import alignment

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
OWN = alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "  ", "a", "Hello world", "Hello  world \n\n x ", " lead", "tab\t x", "a▁b", "<|endoftext|> <s> </s>", "漢字かな", "é́ 🎉🎉 x", "don't we'll", "\n \n", "x  y", "\x00 \x1f a",
    "word " * 50, "1234567890 12 3", "a　 b", "ﬁ ½", "x" * 300, "foo\n bar \t\tbaz   qux", "   ", "a " + "  b", "<0x41> Ġ",
]


def whole(text):
    """Spans of both sides' tokens by the libraries on the whole text, or None."""
    if not text:
        return None
    want = (" " + text).encode()
    sides = []
    for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, OWN.bytes_a), (B.encode(text), OWN.bytes_b)):
        if b"".join(of[i] for i in ids) != want:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(of[i])))
            at += len(of[i])
        sides.append(spans)
    return sides


def brute(texts):
    docs = [whole(t) for t in texts]
    links = [[(x[0], y[0]) for x in d[0] for y in d[1] if x[1] < y[2] and y[1] < x[2]] if d else [] for d in docs]
    count = Counter(p for of in links for p in of)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, of in zip(docs, links):
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shared = sorted({x[2] for x in d[0]} & {y[2] for y in d[1]})
        text, low = [], 0
        for high in shared:
            text.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in d))
            low = high
        out.append((len(d[0]), len(d[1]), len(shared), len(of), sum(count[p] == best[p[1]] for p in of), sum(count[p] for p in of), hashlib.sha256(";".join(text).encode()).hexdigest()))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    signs = ["the", "tion", " ", "  ", "\n", "é", "漢", ".", "'s", "12", "🎉", "\t", "ing", "▁", "zz"]
    return TEXTS + ["".join(rng.choices(signs, weights=[9, 9, 9, 1, 2, 2, 1, 3, 2, 2, 1, 1, 9, 0.02, 2], k=rng.randint(1, 60))) for _ in range(n)] + ["the same text here"] * 20


COLUMNS = (*alignment.NUMBERS, "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent,chunk,kept", [(alignment.FREQUENT, alignment.CHUNK, alignment.KEPT), (30, 7, 40), (0, 1, alignment.KEPT)])
def test_against_brute_force(spark, frequent, chunk, kept):
    """Also where most pairs take the join, long documents come in parts and the workers forget."""
    said = texts(150, 4)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(said)], "doc_id long, text string, a string, n int").repartition(3)
    rows = alignment.aligned(docs, chunk=chunk, kept=kept)
    found = alignment.with_counts(rows, alignment.pair_counts(rows), frequent)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert [got[i] for i in range(len(said))] == brute(said)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'.▁é "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_segments_encode_as_whole_texts(text):
    (at,), want = OWN.segments([text]), whole(text)
    if want is None:
        assert at is None
    else:
        ids = [[i for n in at for i in of[off[n] : off[n + 1]]] for of, off in ((OWN.ids_a, OWN.off_a), (OWN.ids_b, OWN.off_b))]
        assert ids == [[i for i, _, _ in side] for side in want]


def test_empty_table_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(docs).collect()), key=repr)
    want = brute(["a b", "a b", "a b", None])
    assert got == sorted([(i, *w) for i, w in zip((None, 1, 1, 2), want)], key=repr)
    assert alignment.align(docs.where("false")).count() == 0
