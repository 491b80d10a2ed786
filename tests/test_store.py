from datetime import datetime

import pytest
import datetime as dt
import json
import random

from pyspark.sql import functions as F

from memlake.operators import filters, hooks, lifecycle, mail, merge, mutate, parse, replay, search, upkeep
from memlake.sources import exports, store
from memlake import streaming

NOW = "2024-02-01 00:00:00"


def greedy(nodes):
    """Children of the first root, at each fork the branch with the latest leaf, the first on ties."""
    kids = {}
    for n in nodes:
        kids.setdefault(n[2], []).append(n)

    def latest(n):
        return max([latest(c) for c in kids.get(n[1], [])], default=n[4])

    at, path = kids[None][0], []
    while at:
        path.append(at[1])
        below, best = kids.get(at[1], []), None
        for c in below:
            if best is None or latest(c) > latest(best):
                best = c
        at = best
    return path


def test_primary_path_equals_the_greedy_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for conv in range(60):
        nodes = [(conv, "n0", None, 0, "t5")]
        for i in range(1, rng.randint(1, 14)):
            nodes.append((conv, f"n{i}", f"n{rng.randrange(i)}", i, f"t{rng.randint(0, 4)}"))
        rows += nodes
        want[conv] = greedy(nodes)
    df = spark.createDataFrame(rows, "conv_id long, id string, parent_id string, ord int, created_at string")
    assert {r["conv_id"]: r["path"] for r in parse.primary_path(df).collect()} == want


def test_orphans_and_second_roots(spark):
    df = spark.createDataFrame([(1, "a", "gone", 0, None), (1, "b", "a", 1, "t"), (2, "a", None, 0, "t1"), (2, "x", None, 1, "t9"), (2, "b", "a", 2, None)], "conv_id long, id string, parent_id string, ord int, created_at string")
    assert {r["conv_id"]: r["path"] for r in parse.primary_path(df).collect()} == {1: ["a", "b"], 2: ["a", "b"]}


def test_exports(spark, tmp_path):
    tree = {"conversations": [{"uuid": "c1", "name": "n", "created_at": "2024", "updated_at": "2024", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "hi", "created_at": "1", "parent_message_uuid": ""}, {"uuid": "m2", "sender": "assistant", "text": "yo", "created_at": "2", "parent_message_uuid": "m1"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(tree))
    (tmp_path / "b.json").write_text(json.dumps(tree["conversations"]))
    for name in ("a.json", "b.json"):
        got = exports.read_tree_export(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [(r["conv_id"], r["id"], r["parent_id"], r["role"]) for r in got] == [("c1", "m1", None, "human"), ("c1", "m2", "m1", "assistant")]
    mapping = [{"title": "t", "create_time": 5.5, "mapping": {"r": {"id": "r", "parent": None, "children": ["s"]}, "s": {"id": "s", "parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["a", "b"]}, "create_time": 6.0}}}}]
    (tmp_path / "c.json").write_text(json.dumps(mapping))
    got = {r["id"]: r for r in exports.read_mapping_export(spark, str(tmp_path / "c.json")).collect()}
    assert got["s"]["text"] == "a\nb" and got["s"]["conv_id"] == "gpt_5" and got["r"]["parent_id"] is None
    assert exports.newest(spark, str(tmp_path)).endswith("c.json")


def test_session_logs_of_both_dialects(spark, tmp_path):
    first = ['{"type":"user","timestamp":"1","sessionId":"s","message":{"content":"  hello "}}', "bad json", '{"type":"assistant","cwd":"/w","message":{"content":[{"type":"text","text":"a"},{"type":"x","text":"no"},{"type":"text","text":"b"}]}}', '{"type":"user","message":{"content":" "}}']
    second = ['{"type":"session_meta","payload":{"id":"q","cwd":"/z"}}', '{"type":"response_item","payload":{"role":"developer","content":[{"type":"input_text","text":"' + "x" * 900 + '"}]}}']
    (tmp_path / "one.jsonl").write_text("\n".join(first))
    (tmp_path / "two.jsonl").write_text("\n".join(second))
    rows = parse.session_turns(exports.read_session_logs(spark, str(tmp_path))).orderBy("path", "line_no").collect()
    assert [(r["role"], len(r["text"]), r["cwd"]) for r in rows] == [("user", 5, "/w"), ("assistant", 3, "/w"), ("user", 800, "/z")]


def test_mbox_and_gate(spark, tmp_path):
    body = "I think that we should keep the old plan. " * 5
    text = f"From a@b Mon\nFrom: Ann <ann@x.org>\nTo: b@x.org\nSubject: plan\nDate: 2024-01-05T00:00:00Z\nMessage-ID: <1>\n\n{body}\n> quoted\nSent from my phone\nhidden\n\nFrom noreply@x Mon\nFrom: noreply@x.org\nSubject: your order\nDate: 2024-01-05\nMessage-ID: <2>\n\n{body}\n"
    (tmp_path / "m.mbox").write_text(text)
    got = exports.read_mbox(spark, str(tmp_path / "m.mbox")).collect()
    assert [r["id"] for r in got] == ["<1>", "<2>"]
    kept = mail.mail_gate(exports.read_mbox(spark, str(tmp_path / "m.mbox"))).collect()
    assert [r["id"] for r in kept] == ["<1>"] and "hidden" not in kept[0]["content"] and "quoted" not in kept[0]["content"]


def test_pages_commits_and_files(spark):
    html = "<html><head><title>x</title></head><body><p>A &amp; B</p><script>var a='</p>'</script><div>C<br>D</div></body></html>"
    assert spark.range(1).select(mail.html_text(F.lit(html))).first()[0] == "A & B\nC\nD"
    commits = spark.createDataFrame([("r", "1", "2024-01-01", "m" * 60), ("r", "2", "2024-01-02", "Merge " + "m" * 60), ("r", "3", "2024-01-03", "short")], "repo string, sha string, date string, message string")
    assert mail.substantive_commits(commits).first()["log"] == "[2024-01-01] " + "m" * 60
    s = spark.createDataFrame([("s1", "/home/a/proj/sub"), ("s2", "/tmp")], "session_id string, cwd string")
    c = spark.createDataFrame([("/home/a", "one"), ("/home/a/proj", "two")], "path string, repo string")
    assert {r["session_id"]: r["repo"] for r in mail.repository_of(s, c).collect()} == {"s1": "two", "s2": None}


def entries(spark, rows):
    return spark.createDataFrame(rows, "entry_id string, entry_type string, label string, narrative string, confidence string, state string")


def test_replay_plans(spark):
    df = entries(spark, [
        ("a", "knowledge", "Market view", "the market will outperform", "high", "active"), ("b", "knowledge", "market VIEW", "the market will underperform", "high", "active"),
        ("c", "knowledge", "Spark tuning", "use bigger partitions for joins", "high", "active"), ("d", "knowledge", "spark tuning!", "use bigger partitions for joins always", "high", "active"),
        ("e", "project", "same name", "x", "high", "active"), ("f", "project", "Same Name", "totally other", "high", "active"), ("g", "knowledge", "abc", "one", "high", "active"), ("h", "knowledge", "abc", "two", "high", "active"),
    ])
    assert {r["fp"].split(":")[1]: r["plan"] for r in replay.plans(df).collect()} == {"market view": "contest", "spark tuning": "merge", "same name": "merge"}
    got = {r["entry_id"]: (r["state"], r["conflicts"]) for r in replay.contested(df, replay.view_pairs(df)).collect()}
    assert got == {"a": ("contested", ["b"]), "b": ("contested", ["a"])}
    why = spark.range(1).select(replay.internal_contradiction(F.array(F.lit("rising rates"), F.lit("falling rates")))).first()[0]
    assert why == "internal positions contain opposing markers (rising vs falling)"


def test_merge_actions_and_fold(spark):
    kind = "entry_id string, label string, repos array<string>, embedding array<double>, view string, confidence string, state string, insights array<struct<insight:string,snippet:string>>, sources array<string>, evolution array<struct<delta:string,trigger:string,from_view:string,to_view:string>>, positions array<string>"
    row = lambda i, label, repo, v, view: (i, label, [repo], v, view, "high", "active", [("in", f"snip {i}")], [f"c{i}"], [], [])
    old = spark.createDataFrame([row("o1", "spark join tuning", "r1", [1.0, 0.0], "v1"), row("o2", "other topic here", "r2", [0.0, 1.0], "v2")], kind)
    new = spark.createDataFrame([row("n1", "spark join hints", "r1", [1.0, 0.1], "w1"), row("n2", "spark join notes", "r9", [0.9, 0.4], "w2"), row("n3", "nothing alike", "r7", [1.0, 0.0], "w3")], kind)
    log = merge.merge_log(new, merge.matches(new, old), 0.95, 0.5)
    assert {r["new_id"]: (r["old_id"], r["action"]) for r in log.collect()} == {"n1": ("o1", "update"), "n2": ("o1", "evolve"), "n3": (None, "create")}
    after = {r["entry_id"]: r for r in merge.applied(old, new, log).collect()}
    assert sorted(after) == ["n3", "o1", "o2"] and after["o1"]["view"] == "w2" and after["o1"]["sources"] == ["co1", "cn1", "cn2"] and len(after["o1"]["insights"]) == 3 and after["o1"]["evolution"][0]["from_view"] == "v1"
    p = spark.createDataFrame([("p1", "Knowledge Base"), ("p2", "x")], "entry_id string, label string")
    q = spark.createDataFrame([("q1", "base"), ("q2", ""), ("q3", "the knowledge base app")], "entry_id string, label string")
    assert {r["new_id"]: r["old_id"] for r in merge.project_matches(q, p).collect()} == {"q1": "p1", "q3": "p1"}


def test_mutations(spark):
    e = spark.createDataFrame([("k1", 0, False, "v", "high", "active", "task_query", ["Known fact"])], "entry_id string, revision int, archived boolean, view string, confidence string, state string, context_type string, insights array<string>")
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    m = spark.createDataFrame([
        ("m1", t(1), "update", "k1", 0, "v2", None, None, None, None), ("m1", t(9), "update", "k1", 0, "v9", None, None, None, None), ("m2", t(2), "update", "k1", 0, "v3", None, None, None, None),
        ("m3", t(3), "insight", "k1", None, None, None, None, None, "known FACT!"), ("m4", t(4), "archive", "k1", 1, None, None, None, None, None), ("m5", t(5), "insight", "k1", None, None, None, None, None, "new"),
        ("m6", t(6), "restore", "k1", 2, None, None, None, None, None), ("m7", t(1), "create", "k2", None, "made", None, None, None, "i"), ("m8", t(1), "update", "k3", None, "x", None, None, None, None),
    ], "mutation_id string, ts timestamp, kind string, entry_id string, expected_revision int, view string, confidence string, state string, context_type string, insight string")
    after, results = mutate.fold(e, m)
    assert {r["mutation_id"]: (r["status"], r["revision"]) for r in results.collect()} == {"m1": ("ok", 1), "m2": ("conflict", 1), "m3": ("noop", 1), "m4": ("ok", 2), "m5": ("archived", 2), "m6": ("ok", 3), "m7": ("ok", 1), "m8": ("not_found", 0)}
    got = {r["entry_id"]: r for r in after.collect()}
    assert sorted(got) == ["k1", "k2"] and got["k1"]["view"] == "v2" and got["k2"]["context_type"] == "explicit_save" and got["k2"]["confidence"] == "medium"


def test_consolidation_is_all_or_nothing(spark):
    e = spark.createDataFrame([("a", "knowledge", 0, False), ("b", "knowledge", 3, False), ("c", "project", 0, False)], "entry_id string, entry_type string, revision int, archived boolean")
    r = spark.createDataFrame([("m1", "a", ["b"], {"a": 0, "b": 3}), ("m2", "a", ["c"], {})], "mutation_id string, keep_id string, archive_ids array<string>, expected_revisions map<string,int>")
    after, results = mutate.consolidate(e, r)
    assert {x["mutation_id"]: x["status"] for x in results.collect()} == {"m1": "ok", "m2": "conflict"}
    assert sorted(map(tuple, after.select("entry_id", "revision", "archived").collect())) == [("a", 1, False), ("b", 4, True), ("c", 0, False)]


def test_vector_topk_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)] + [(150, [0.0] * 5), (151, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 30 = 0 and embedding is not null").withColumnRenamed("vec_id", "query_id")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if any(a) and any(b) else 0.0
    want = {i: [j for _, j in sorted((-round(cos(v, w), 12), j) for j, w in rows if w is not None)[:4]] for i, v in rows if i % 30 == 0 and v}
    got = {}
    for r in search.vector_topk(q.unionByName(q.limit(1).withColumn("embedding", F.lit(None).cast("array<float>")), allowMissingColumns=True), df, 4, block=2).orderBy("query_id", F.col("similarity").desc(), "vec_id").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {k: v for k, v in got.items() if k != 150} == {k: v for k, v in want.items() if k != 150}


def test_hooks(spark):
    df = spark.createDataFrame([(i, f"word{i} x") for i in range(7)], "entry_id long, text string")
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in hooks.embed(df, hooks.hashed_embedding, batch=3).collect())

    def picky(items):
        if any(i["entry_id"] == 4 for i in items):
            raise ValueError
        return {i["entry_id"]: "task_query" for i in items}

    assert sorted(r["entry_id"] for r in hooks.classify(df, picky, 5).collect()) == [0, 1, 2, 3, 5, 6]


def test_upkeep(spark):
    runs = spark.createDataFrame([("r1", dt.datetime(2024, 1, 31, 7, 15), "ok", "cron", False, True), ("r2", dt.datetime(2024, 1, 31, 9, 0), "failed", "manual", True, True)], "run_id string, run_at timestamp, status string, trigger string, dry_run boolean, set_as_latest boolean")
    assert {r["run_id"]: r["issues"] for r in upkeep.run_issues(runs, "2024-01-31 15:00:00").collect()} == {"r1": "", "r2": "late_start,status,trigger,dry_run"}
    assert {r["run_id"]: r["issues"] for r in upkeep.run_issues(runs, "2024-02-01 01:00:00").collect()}["r1"] == ""
    assert tuple(upkeep.latest_run(runs).first()) == ("r1", "r2")


def test_store_versions(spark, tmp_path):
    a = spark.createDataFrame([("a", "knowledge", 1), ("b", "project", 1)], "entry_id string, entry_type string, n int")
    b = spark.createDataFrame([("b", "project", 2), ("c", "knowledge", 2)], "entry_id string, entry_type string, n int")
    store.write_version(a, str(tmp_path), 1)
    store.write_version(store.upserted(store.read_latest(spark, str(tmp_path)), b), str(tmp_path), 2)
    assert sorted((r["entry_id"], r["n"]) for r in store.read_latest(spark, str(tmp_path)).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_streams(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [(1, dt.datetime(2024, 1, 1, 0, m), "k") for m in (1, 2, 3)] + [(2, dt.datetime(2024, 1, 1, 5, 0), "k")]
    spark.createDataFrame(rows, "entry_id long, ts timestamp, key string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("entry_id long, ts timestamp, key string").parquet(str(src))
    for name, df, mode in (("promoted", streaming.repeated_access(stream), "complete"), ("rates", streaming.rate_windows(stream, 2), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert [r["entry_id"] for r in spark.table("promoted").collect()] == [1]
    assert [(r["calls"], r["allowed"]) for r in spark.table("rates").collect()] == [(3, False)]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"type":"user","message":{"content":"hello"}}\n')
    streaming.ingest(spark, str(logs), str(tmp_path / "turns"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["text"] for r in streaming.ingested_turns(spark, str(tmp_path / "turns")).collect()] == ["hello"]


def test_abandoned_needs_three_messages(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "I decided to use it."), (2, 1, "assistant", None), (3, 0, "user", "x"), *[(3, i, "assistant", "error") for i in (1, 2, 3)]], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in filters.scored(df).collect()}
    assert not got[1]["abandoned"] and got[2]["decided"] and got[3]["abandoned"] and got[3]["skip_reason"] == "pure_troubleshooting"


def test_budget_sequence(spark):
    df = spark.range(1000).select((F.col("id") + 1).cast("int").alias("place"), F.lit(10).alias("tokens"))
    assert lifecycle.budgeted(df, 5200).count() == 512
    last = lifecycle.budgeted(df, 5)
    assert last.first()["over_budget"] and 0 < last.count() <= 100


def test_numbered_is_one_sequence(spark):
    from memlake.plans.tables import numbered

    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id").repartition(7)
    got = [r["place"] for r in numbered(df, [F.col("k").desc(), F.col("id")]).orderBy(F.col("k").desc(), "id").collect()]
    assert got == list(range(1, 501))


def test_distill_run(spark):
    from memlake.plans import distill

    nodes = spark.createDataFrame([("c1", "a", None, 0, "human", "I decided to use spark ```x```", "1"), ("c1", "b", "a", 1, "assistant", "good", "2"), ("c2", "a", None, 0, "human", "hi", "1")], "conv_id string, id string, parent_id string, ord int, role string, text string, created_at string")
    kind = "entry_id string, label string, repos array<string>, embedding array<double>, view string, confidence string, state string, insights array<struct<insight:string,snippet:string>>, sources array<string>, evolution array<struct<delta:string,trigger:string,from_view:string,to_view:string>>, positions array<string>"
    store_ = spark.createDataFrame([], kind)

    def to_entries(answers):
        return answers.select(F.concat(F.lit("ke_"), F.col("conv_id")).alias("entry_id"), F.col("answer").alias("label"), F.array().cast("array<string>").alias("repos"), F.array(F.lit(1.0)).alias("embedding"), F.col("answer").alias("view"), F.lit("high").alias("confidence"), F.lit("active").alias("state"), F.array().cast("array<struct<insight:string,snippet:string>>").alias("insights"), F.array("conv_id").alias("sources"), F.array().cast("array<struct<delta:string,trigger:string,from_view:string,to_view:string>>").alias("evolution"), F.array().cast("array<string>").alias("positions"))

    out = distill.run(nodes, spark.createDataFrame([], "conv_id string"), store_, lambda p: "spark use", to_entries, NOW)
    assert [r["entry_id"] for r in out["entries"].collect()] == ["ke_c1"]
    assert (out["report"].first()["parsed"], out["report"].first()["kept"], out["report"].first()["create"]) == (2, 1, 1)


def test_evidence(spark):
    e = spark.createDataFrame([("a", "two words", [("i", ["m1", "m9"])]), ("b", "one", [("i", []), ("j", None)])], "entry_id string, label string, insights array<struct<insight:string,message_ids:array<string>>>")
    got = sorted(map(tuple, upkeep.evidence_issues(e, spark.createDataFrame([("m1",)], "message_id string")).collect()))
    assert got == [("a", "unknown_message:m9"), ("b", "insight_without_messages:0"), ("b", "insight_without_messages:1"), ("b", "short_label")]


def test_change_detection_sees_edits_anywhere_in_a_turn(spark):
    from memlake.operators import upkeep
    from memlake.queries import _hashes

    long = "word " * 100
    rows = [(1, 0, long), (1, 1, "b"), (2, 0, long), (2, 1, None), (3, 0, long), (3, 1, "a|b"), (4, 0, None), (5, 0, "x")]
    after = [(1, 0, long + "end"), (1, 1, "b"), (2, 0, long), (2, 1, ""), (3, 1, "a|b"), (3, 0, long), (4, 0, None), (6, 0, "x")]
    make = lambda r: _hashes(spark.createDataFrame(r, "conv_id long, turn int, text string"))
    got = {r["conv_id"]: r["change"] for r in upkeep.changes(make(rows), make(after)).collect()}
    assert got == {1: "changed", 2: "changed", 3: "unchanged", 4: "unchanged", 5: "deleted", 6: "new"}


def test_archive_reset_and_runs(spark, tmp_path):
    from memlake.sources import store

    e = spark.createDataFrame([(1, "knowledge", "a"), (2, "project", "b"), (3, "project", None)], "entry_id long, entry_type string, view string")
    root = str(tmp_path)
    kept = store.archive_full_content(e, root)
    assert [r["full_content_ref"] for r in kept.orderBy("entry_id").collect()] == [f"{root}/archive_content/{i}" for i in (1, 2, 3)]
    assert store.full_content(spark, root, e.where("entry_id = 2").select("entry_id")).first()["content"] == '{"entry_id":2,"entry_type":"project","view":"b"}'
    store.write_version(e, root, 1)
    assert {r["entry_type"]: r["entries"] for r in store.reset_store(e, root, 2).collect()} == {"knowledge": 1, "project": 2}
    for i in (1, 2):
        store.append_run_report(spark.createDataFrame([(f"r{i}", i)], "run_id string, kept long"), root)
    assert sorted((r["run_id"], r["kept"]) for r in store.runs(spark, root).collect()) == [("r1", 1), ("r2", 2)]


def test_migration_gate_and_project_entries(spark):
    from memlake.operators import views

    e = spark.createDataFrame([(1, None, False), (2, "task_query", False), (3, None, True)], "entry_id long, context_type string, archived boolean")
    with pytest.raises(ValueError, match="1 entries"):
        views.complete_migration(e)
    views.complete_migration(e.where("entry_id <> 1"))
    kind = "conv_id long, created_at string, updated_at string, n long, label string, view string, confidence string, phase string, points array<struct<text string, message_ids array<string>, snippet string>>"
    rows = [(1, "c", "u", 1, "tool", "goal", None, "build", [("use it", ["m2", "m1", "m2"], "s" * 300)]), (1, "c", "u", 2, "", "goal", None, "build", []), (2, "c", "u", 1, "other", "goal", "low", "", None)]
    got = sorted(views.converted(spark.createDataFrame(rows, kind), project=True).collect(), key=lambda r: r["label"], reverse=True)
    assert [(r["label"], r["history"], r["source_messages"], r["confidence"], len(r["first_evidence"] or "")) for r in got] == [("tool", ["build"], ["m1", "m2"], "medium", 200), ("other", [], [], "low", 0)]
    assert all(r["entry_id"].startswith("pe_") for r in got)


def test_live_cycle_merges_contests_and_archives(spark):
    from memlake.operators import lifecycle

    kind = """entry_id long, entry_type string, label string, narrative string, context_type string, confidence string, mention_count long, access_count long, last_accessed timestamp, last_seen timestamp,
    updated_at timestamp, state string, archived boolean, tier int, sources array<string>, insights array<string>, links array<struct<knowledge_id: bigint, relationship: string>>, notes array<string>"""
    at = datetime(2024, 1, 1)
    row = lambda i, label, said, sources, kind="recurring_pattern", conf="high": (i, "knowledge", label, said, kind, conf, len(sources), 0, None, at, at, "active", False, None, sources, [said, "both"], [], [])
    rows = [
        row(1, "Rust builds", "use cargo for every build", ["a", "b"]), row(2, "rust builds", "use cargo for every build of it", ["b", "c"]),
        row(3, "Market view", "prices will increase soon", ["d"]), row(4, "market view", "prices will decrease soon", ["e"]),
        row(5, "Passing thing", "something small", ["f"], "passing_reference", "low"),
    ]
    entries = spark.createDataFrame(rows, kind)
    access = spark.createDataFrame([(2, 4, at)], "entry_id long, access_count long, last_accessed timestamp")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    dry = lifecycle.cycle(entries, access, now, "r0")
    assert {r["entry_id"]: r["archived"] for r in dry["entries"].collect()} == dict.fromkeys(range(1, 6), False) and dry["archive"].count() == 0
    live = lifecycle.cycle(entries, access, now, "r1", dry_run=False)
    got = {r["entry_id"]: r for r in live["entries"].collect()}
    run = live["run"].first()
    assert (run["merge_plans"], run["contest_plans"]) == (1, 1)
    main, other = (got[2], got[1]) if got[1]["archived"] else (got[1], got[2])
    assert other["archived"] and not main["archived"] and sorted(main["sources"]) == ["a", "b", "c"] and main["mention_count"] == 3 and main["access_count"] == 4 and other["access_count"] == 0
    assert len(main["insights"]) == 3 and "merge_duplicate_entries" in main["notes"][-1]
    assert got[3]["state"] == got[4]["state"] == "contested" and got[3]["links"][0]["knowledge_id"] == 4 and got[4]["notes"]
    assert got[5]["archived"] and {r["entry_id"] for r in live["archive"].collect()} == {other["entry_id"], 5}


def test_long_turns_are_cut(spark):
    from memlake.operators import parse

    df = spark.createDataFrame([(1, 0, "user", "a" * 3000), (1, 1, "assistant", "b" * 3001), (1, 2, "user", None), (2, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r["prompt"] for r in parse.prompt(df).collect()}
    assert got[1] == "[0] USER: " + "a" * 3000 + "\n\n[1] ASSISTANT: " + "b" * 2900 + "\n[... truncated ...]\n\n[2] USER: " and got[2] == "[0] USER: x"
    long = spark.createDataFrame([(1, i, "user", "a" * 2001) for i in range(5)], "conv_id long, turn int, role string, text string")
    assert sorted(r["turn"] for r in parse.session_window(long).collect()) == [0, 1, 2]
