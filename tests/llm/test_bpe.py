import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from memlake.llm.bpe import Codec, StreamDecoder, decode, encode, load_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    own = Codec(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.machine.ranks, special_tokens={})


def test_random_texts_match(pair):
    own, ref = pair
    rng = random.Random(3)
    parts = ["a", "e", "th", "the", "ing", " ", "  ", "\n", "\x1c", "é", "日本", "😀", "1", "23", "'s", "!", "...", "​", "x" * 30, "\x85", "ab", "B", "\r\n", "aaaa", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = own.encode(text)
        assert array("I", ids).tolist() == ref.encode_ordinary(text), repr(text)
        assert own.decode(ids, block=rng.randint(1, 5)) == text


def test_every_token_of_its_own_bytes(pair):
    own, ref = pair
    for word, rank in list(own.machine.ranks.items())[::37]:
        assert own.machine.joined(-1, rank) == (ref._core_bpe.encode_single_piece(word) == [rank])


def test_stream_decoder_holds_back_cut_signs():
    decoder = StreamDecoder({i: bytes([i]) for i in range(256)})
    assert decoder.push("é".encode()[:1]) == ""
    assert decoder.push("é".encode()[1:]) == "é"
    assert [decoder.push([b]) for b in "😀".encode()] == ["", "", "", "😀"]
    assert decoder.push([0xF0, 0x9F]) == "" and decoder.close() == "�"
    assert decoder.push([0xFF, 65]) == "�A"


def test_table_edges(spark, pair):
    own, ref = pair
    rows = [(1, None, "k"), (2, "", "k"), (2, "twice", "k"), (2, "twice", "k"), (3, "q" * 50000 + " é\n\n  x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == sorted((i, len(ref.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = decode(encode(df)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    assert encode(df.limit(0), digest=True).count() == 0
    for r in encode(df, digest=True).collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(array("I", ref.encode_ordinary(r["text"] or "")).tobytes()).hexdigest()
