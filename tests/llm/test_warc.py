import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from memlake.llm import warc


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers) of (page_id, url, html), ids all different."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, d in sorted(data):
        first.setdefault(d, i)
    out = []
    for i, d in data:
        other = first[d] if len(d) >= least and first[d] != i else None
        out.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if other is None else "revisit", other))
    return sorted(out)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, head string, address string")


def texts(seed):
    rng = random.Random(seed)
    pool = ["", None, "a", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\u0000漢\r\n\r\n", "x" * 200_000] + ["".join(rng.choices("ab\r\n<é", k=rng.randint(1, 40))) for _ in range(60)]
    return [(i * 3 - 50, rng.choice(["http://e.org/a b\r\nX: 1", None, f"http://h/{i}", "http://ü/?<q>"]), rng.choice(pool)) for i in rng.sample(range(400), 300)]


def test_against_brute_force(spark, tmp_path):
    rows = texts(1)
    for least in (0, 2, 50):
        root = str(tmp_path / f"a{least}")
        warc.archive_pages(pages_of(spark, rows).repartition(7), root, least)
        found = warc.digests(warc.restore(spark, root))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows, least), key=repr)
        assert spark.read.parquet(f"{root}/payloads").count() == len({(h or "") for _, _, h in rows})


def test_files_round_trip_byte_by_byte(spark, tmp_path):
    """Pages to files, files to records, records to an archive and back: the same bytes each time."""
    rows = texts(2)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    warc.archive_pages(pages_of(spark, rows).repartition(3), one)
    whole = warc.restore(spark, one)
    exact = sorted(bytes(r[0]) for r in whole.select(warc.record(whole)).collect())
    for kind in ("gzip", "none"):
        files = str(tmp_path / f"files-{kind}")
        warc.write_files(whole, files, records=40, compression=kind)
        assert len([f for f in os.listdir(files) if f.startswith("part")]) > 3
        read = warc.read_files(spark, files, "part*")
        assert sorted(bytes(r["head"]) + bytes(r["payload"] or b"") for r in read.collect()) == exact
    warc.archive_records(read, two)
    again = warc.restore(spark, two)
    assert sorted(bytes(r[0]) for r in again.select(warc.record(again)).collect()) == exact
    held = again.where(warc.header(F.col("head"), "WARC-Type") == "revisit")
    assert held.where("payload is not null").count() == 0 and held.count() > 0


def test_members_and_other_kinds(spark, tmp_path):
    import gzip

    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\na: b\n"
    dns = b"WARC/1.0\r\nwarc-type: resource\r\ncontent-type: text/dns\r\ncontent-length: 0\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info + b"\r\n\r\n") + gzip.compress(dns + b"\r\n\r\n"))
    got = sorted((r["nth"], bytes(r["head"]), bytes(r["payload"])) for r in warc.read_files(spark, str(tmp_path)).collect())
    assert got == [(0, info[:-5], b"a: b\n"), (1, dns, b"")]
    (tmp_path / "a.warc.gz").write_bytes(info[:-2])
    with pytest.raises(Exception, match="cut off"):
        warc.read_files(spark, str(tmp_path)).collect()


def test_repeated_and_null_ids(spark, tmp_path):
    root = str(tmp_path / "a")
    rows = [(None, "u", "one"), (5, "u", "one"), (5, "u", "one"), (2, None, "two"), (2, "u", None), (None, None, None), (None, None, "three")]
    warc.archive_pages(pages_of(spark, rows), root)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.digests(warc.restore(spark, root)).collect()), key=repr)
    want = [(5, "response", None, 3), (5, "revisit", 5, 3), (None, "revisit", 5, 3), (2, "response", None, 3), (2, "response", None, 0), (None, "revisit", 2, 0), (None, "response", None, 5)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    root = str(tmp_path / "a")
    warc.archive_pages(pages_of(spark, [(1, "u", "x")]).where("false"), root)
    assert warc.digests(warc.restore(spark, root)).count() == 0


def test_damage_is_told(spark, tmp_path):
    root = str(tmp_path / "a")
    warc.archive_pages(pages_of(spark, [(1, "u", "x"), (2, "u", "y")]), root)
    spark.read.parquet(f"{root}/payloads").withColumn("payload", F.lit("z").cast("binary")).write.parquet(f"{root}/bad")
    os.rename(f"{root}/payloads", f"{root}/good")
    os.rename(f"{root}/bad", f"{root}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.digests(warc.restore(spark, root)).collect()


def test_a_hot_payload_joins_in_parts(spark, tmp_path):
    """Heads of one payload that a third of the pages share are not one task's: the join's exchanges can be split."""
    rows = [(i, "http://h/", "hot" if i % 3 == 0 else f"cold {i}") for i in range(3000)]
    root = str(tmp_path / "a")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pages = pages_of(spark, rows).repartition(8)
        warc.archive_pages(pages, root)
        for df in (warc.restore(spark, root), warc.heads(pages)):
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
