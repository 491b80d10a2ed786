"""Extra columns of any type and name come through every operator on documents."""

from memlake.llm import licenses, line_dedup, mixing, pii, quality

PASSAGE = " ".join(f"word{i}, next" for i in range(60))


def docs_of(spark):
    rows = [(i, f"own start {i}. {PASSAGE} end{i}.", "en", "s", {"k": i}, i, "t", f"h{i}", "w") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m map<string,int>, `a.b` int, __t string, __h string, `__w` string")


def test_columns_stay(spark):
    docs = docs_of(spark)
    sized = mixing.sizes(docs).join(docs.select("doc_id", "m", "__t", "__h", "`a.b`", "__w"), "doc_id")
    for df in (line_dedup.dedup(docs), pii.spans(docs), quality.apply_rules(docs), licenses.scan(docs), mixing.mix(sized)):
        got = {r["doc_id"]: r for r in df.collect()}
        assert len(got) == 6
        for i, r in got.items():
            assert (r["m"], r["a.b"], r["__t"], r["__h"], r["__w"]) == ({"k": i}, i, "t", f"h{i}", "w")
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert PASSAGE[:200] in cut[0] and all(PASSAGE[20:200] not in cut[i] for i in range(1, 6))


def test_shorter_stretches_on_demand(spark):
    lines = "\n".join(f"line {i} has just seven words here" for i in range(5))
    docs = spark.createDataFrame([(i, f"start{i} other{i}\n{lines}\nend{i}") for i in range(50)], "doc_id long, text string")
    assert sum("line 2" in r["text"] for r in line_dedup.dedup(docs).collect()) == 50
    assert sum("line 2" in r["text"] for r in line_dedup.dedup(docs, least=20).collect()) == 1
