import random
import re
from array import array

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from memlake.llm.bpe import load_ranks
from memlake.llm.line_dedup import dedup
from tests.llm import brute


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() + rng.choice(["", "", "", "", "", ".", ",", ".\n"]) for _ in range(k)).replace("\n ", "\n")
    passage, rows = prose(70), []
    for _ in range(n):
        text = prose(rng.randint(25, 200))
        kind = rng.random()
        if kind < 0.2:
            text += " " + passage
        elif kind < 0.3 and rows:
            text = rng.choice(rows)
        elif kind < 0.45 and rows:
            w = rng.choice(rows).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.52:
            text = rng.choice([prose(8), text.upper(), (word() + " ") * 80, text.replace(" ", " | "), ""])
        rows.append(text)
    return [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t)) for i, t in enumerate(rows)] + [(n, None, "en", "b", 0)]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = [(r[0], r[1]) for r in corpus(seed)] + [(3, "same. id, other text. " * 9), (None, "same. id, other text. " * 9)]
    rows.append(rows[4])
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    want = [(k, t) for (k, _), t in zip(rows, brute.line_dedup(rows))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(t is not None and len(t) for _, t in want) < sum(t is not None and len(t) for _, t in rows)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if brute.quality(r[1])]
    texts = brute.line_dedup([(r[0], r[1]) for r in kept])
    kept = [(r[0], t, r[3]) for r, t in zip(kept, texts) if re.search(brute.WORD, t)]
    first = {d for d, _, c in brute.components([(k, t) for k, t, _ in kept]) if d == c}
    mixed = brute.source_mix([(k, s, t) for k, t, s in kept if k in first])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    squeeze = lambda t: re.findall(brute.WORD, t)
    assert sorted((r["doc_id"], squeeze(r["text"])) for r in got) == sorted((k, squeeze(t)) for k, t in mixed)
    assert 20 < len(first) < len(kept) < len(rows)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in got:
        assert list(r["ids"]) == ref.encode_ordinary(r["text"]) and r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] and array("I", r["ids"])


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(7, 30), KIND)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    empty = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
