"""Log following, exactly-once tables and stateful mutations, with restarts and failures in between."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from memlake import streaming
from memlake.operators import mutate, parse
from memlake.sources import exports, tailing
from memlake.streaming import sink, stateful


def said(text, **more):
    return json.dumps({"type": "user", "message": {"content": text}, **more}) + "\n"


def add(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_give_each_line_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(tailing, "BLOCK", 5)
    rng = random.Random(split)
    lines = ["".join(rng.choices("aé ", k=rng.choice([0, 1, 3, 20]))) for _ in range(60)]
    whole = "\n".join(lines).encode()
    (tmp_path / "a.log").write_bytes(whole)
    files = tailing.Files(str(tmp_path), "*.log")
    ((path, size),) = files.sizes().items()
    for low in (0, whole.find(b"\n") + 1):
        got = [x for part in tailing.ranges(path, low, size, split) for x in files.lines(part)]
        want, at = [], 0
        for line in whole.split(b"\n"):
            if at >= low and at < size:
                want.append((at, line))
            at += len(line) + 1
        assert got == want
    assert files.whole(path, 0, size) == whole.rfind(b"\n") + 1 and files.whole(path, whole.rfind(b"\n") + 1, size) == whole.rfind(b"\n") + 1


def test_logs_that_grow(spark, tmp_path):
    """A log appended twice gives each line once, across a restart; a half-written line waits; a replaced file is new."""
    logs, root, ck = tmp_path / "logs", str(tmp_path / "turns"), str(tmp_path / "ck")
    logs.mkdir()
    a, b = str(logs / "a.jsonl"), str(logs / "b.jsonl")

    def run():
        streaming.ingest(spark, str(logs), root, ck).awaitTermination(120)
        return sorted(r["text"] for r in streaming.ingested_turns(spark, root).collect())

    add(a, said("one") + said("two")[:20])
    assert run() == ["one"]
    add(a, said("two")[20:] + "\nnot json\n" + said("three", cwd="/w"))
    add(b, '{"type":"session_meta","payload":{"id":"q","cwd":"/z"}}\n')
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]
    add(b, '{"type":"response_item","payload":{"role":"assistant","content":"four"}}\n')
    assert run() == ["four", "one", "three", "two"]
    got = sorted((r["role"], r["text"], r["cwd"]) for r in streaming.ingested_turns(spark, root).collect())
    whole = parse.session_turns(exports.read_session_logs(spark, str(logs)))
    assert got == sorted((r["role"], r["text"], r["cwd"]) for r in whole.collect())
    batch = parse.session_turns(tailing.read_logs(spark, str(logs), split=16).withColumnRenamed("offset", "line_no"))
    assert got == sorted((r["role"], r["text"], r["cwd"]) for r in batch.collect())
    (logs / "b.jsonl").write_text(said("new"))
    assert run() == ["four", "new", "one", "three", "two"]


def test_an_epoch_counts_once(spark, tmp_path, monkeypatch):
    """A query fails after its data are written, and another time after the ledger is; counts are right both times."""
    src, root, ck = str(tmp_path / "events"), str(tmp_path / "access"), str(tmp_path / "ck")
    at = dt.datetime(2024, 1, 1)
    event = lambda n, i: spark.createDataFrame([(i, at)] * n, "entry_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("entry_id long, ts timestamp").parquet(src)
    run = lambda: streaming.count_access(stream(), root, ck).awaitTermination(120)
    totals = lambda: {r["entry_id"]: r["access_count"] for r in streaming.access_totals(spark, root).collect()}
    event(3, 1)
    run()
    assert totals() == {1: 3}
    given = sink.append_once
    for late in (False, True):
        event(2, 2)
        before = totals()

        def failing(batch, epoch, place, query):
            if late:  # noqa: B023
                given(batch, epoch, place, query)
            else:
                batch.write.mode("overwrite").parquet(f"{place}/data/query={query}/epoch={epoch}")
            raise OSError("lost")

        monkeypatch.setattr(sink, "append_once", failing)
        with pytest.raises(Exception, match="lost"):
            run()
        monkeypatch.setattr(sink, "append_once", given)
        assert totals() == (before | {2: before.get(2, 0) + 2} if late else before)
        run()
        assert totals() == before | {2: before.get(2, 0) + 2}
    assert sink.committed(spark, root, streaming.ACCESS.format(key="bigint")).select("epoch").distinct().count() == 3


MUTATION = "mutation_id string, ts timestamp, kind string, entry_id string, expected_revision int, view string, confidence string, state string, context_type string, insight string"
ENTRY = "entry_id string, revision int, archived boolean, view string, confidence string, state string, context_type string, insights array<string>"


def test_stateful_mutations_equal_the_fold(spark, tmp_path):
    """The same events in several batchings give the fold's results and entries; replays give what is stored."""
    rng = random.Random(8)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=s)
    events = []
    for n in range(60):
        kind = rng.choice(["create", "update", "insight", "insight", "archive", "restore"])
        events.append((f"m{n}", at(n), kind, f"e{rng.randrange(5)}", rng.choice([None, None, 0, 1, 2]), rng.choice([None, f"v{n}"]), None, rng.choice([None, "stale"]), None, rng.choice(["Known fact", "x y", f"i{n}"])))
    entries = spark.createDataFrame([("e1", 0, False, "v", "high", "active", "task_query", ["known FACT"]), ("e2", 4, True, None, None, None, None, None)], ENTRY)
    after, results = mutate.fold(entries, spark.createDataFrame(events, MUTATION))
    results = {r["mutation_id"]: (r["status"], r["revision"]) for r in results.collect()}
    after = {r["entry_id"]: tuple(r[c] for c in mutate.STATE) for r in after.collect()}
    stateful.rocksdb(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name, cuts in (("many", [7, 30, 31, 60]), ("one", [60])):
            src, ck = str(tmp_path / f"src-{name}"), str(tmp_path / f"ck-{name}")
            rows, low = [], 0
            for high in cuts:
                batch = events[low:high] + (rng.sample(events[:low], 5) if low else [])
                rng.shuffle(batch)
                spark.createDataFrame(batch, MUTATION).coalesce(1).write.mode("append").parquet(src)
                low = high
                found = stateful.mutations(spark.readStream.schema(MUTATION).parquet(src), entries)
                out = str(tmp_path / f"out-{name}")
                found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180)
            rows = spark.read.parquet(out).collect()
            assert all((r["status"], r["revision"]) == results[r["mutation_id"]] for r in rows if r["mutation_id"])
            assert sorted(r["mutation_id"] for r in rows if r["replayed"] is False) == sorted(results)
            assert sum(bool(r["replayed"]) for r in rows) == 5 * (len(cuts) - 1)
            last = {}
            for r in sorted((r for r in rows if r["mutation_id"] is None), key=lambda r: r["revision"]):
                last[r["entry_id"]] = tuple(r[c] for c in mutate.STATE)
            touched = {e[3] for e in events}
            assert last == {k: v for k, v in after.items() if k in touched}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_results_expire(spark, tmp_path):
    """Past the time that results are kept a mutation id is a new one."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    m = lambda i, h, kind="insight": (i, at(h), kind, "e", None, None, None, None, None, i)
    src, ck, out = (str(tmp_path / x) for x in ("src", "ck", "out"))
    stateful.rocksdb(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for batch in ([m("a", 0, "create")], [m("a", 1, "create")], [m("far", 100)], [m("a", 101, "create")]):
            spark.createDataFrame(batch, MUTATION).coalesce(1).write.mode("append").parquet(src)
            found = stateful.mutations(spark.readStream.schema(MUTATION).parquet(src))
            found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r["status"], r["replayed"]) for r in spark.read.parquet(out).where("mutation_id = 'a'").collect())
    assert got == [("exists", False), ("ok", False), ("ok", True)]
