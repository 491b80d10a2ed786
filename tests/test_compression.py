"""Compression against a plain rendering of its rules."""

import datetime as dt
import json

from pyspark.sql import functions as F

from memlake.operators import compression
from memlake.sources import store

NOW = "2024-06-01 00:00:00"
SCHEMA = """entry_id string, entry_type string, detail_level string, state string, updated_at timestamp, access_count int, full_content_ref string, view string,
insights array<struct<insight string, snippet string>>, abilities array<string>, questions array<string>, evolution array<struct<delta string, trigger string, from_view string, to_view string, date string>>"""


def entry(i, kind="knowledge", detail="full", state="active", days=200, access=0, insights=4, changes=(300, 200), view="v" * 300):
    at = lambda n: (dt.datetime(2024, 6, 1) - dt.timedelta(days=n)).isoformat()
    return (i, kind, detail, state, dt.datetime(2024, 6, 1) - dt.timedelta(days=days), access, None, view, [(f"insight {n} " + "i" * 200, f"s{n}") for n in range(insights)], ["a", "b", "c"], ["q"],
            [(f"d{n}", "t", f"from{n} " + "f" * 80, f"to{n} " + "o" * 80, at(n)) for n in changes])


def test_rules(spark, tmp_path):
    rows = [
        entry("plain"), entry("told"), entry("told-none", insights=1), entry("bare", insights=0, changes=(), view=None), entry("one", changes=(100,)), entry("project", kind="project"),
        entry("done", detail="compressed"), entry("contested", state="contested"), entry("new", days=90), entry("used", access=3), entry("changed", changes=(300, 60)),
    ]
    told = spark.createDataFrame([("told", "short view", ["x" * 200, "y"]), ("told-none", "", []), ("nobody", "z", ["z"])], "entry_id string, view string, insights array<string>")
    df = spark.createDataFrame(rows, SCHEMA)
    after, log = compression.compress(df, str(tmp_path), NOW, told)
    assert after.columns == df.columns
    got, by_id = {r["entry_id"]: r for r in after.collect()}, {r[0]: r for r in rows}
    assert {r["entry_id"]: r["reason"] for r in log.collect()} == {
        "plain": None, "told": None, "told-none": None, "bare": None, "one": None, "done": "already_compressed", "contested": "contested", "new": "recently_updated", "used": "often_accessed", "changed": "recently_evolved",
    }
    for i in ("project", "done", "contested", "new", "used", "changed"):
        assert json.loads(json.dumps(tuple(got[i]), default=str)) == json.loads(json.dumps(by_id[i], default=str))
    short = [i for i in got if got[i]["detail_level"] == "compressed" and i != "done"]
    assert sorted(short) == ["bare", "one", "plain", "told", "told-none"]
    assert all(got[i]["abilities"] == ["a", "b"] and got[i]["questions"] == [] for i in short)
    assert got["plain"]["view"] == "v" * 200 and [tuple(x) for x in got["plain"]["insights"]] == by_id["plain"][8][:3]
    assert got["told"]["view"] == "short view" and [tuple(x) for x in got["told"]["insights"]] == [("x" * 150, "s0"), ("y", "s1")]
    assert got["told-none"]["view"] == "v" * 200 and [tuple(x) for x in got["told-none"]["insights"]] == by_id["told-none"][8]
    assert (got["bare"]["view"], got["bare"]["insights"], got["bare"]["evolution"]) == (None, [], [])
    assert [tuple(x) for x in got["one"]["evolution"]] == by_id["one"][11]
    first, last = by_id["plain"][11]
    assert [tuple(x) for x in got["plain"]["evolution"]] == [(f"Evolved through 2 stages: {first[2][:50]}... → {last[3][:50]}...", "Multiple conversations", first[2], last[3], last[4])]
    full = {r["entry_id"]: json.loads(r["content"]) for r in store.full_content(spark, str(tmp_path), after.select("entry_id")).collect()}
    assert sorted(full) == sorted(short) and full["plain"]["view"] == "v" * 300 and len(full["told"]["insights"]) == 4
    assert all(got[i]["full_content_ref"].endswith(f"/{i}") for i in short)
    again, log = compression.compress(after, str(tmp_path), NOW)
    assert log.where("action = 'compressed'").count() == 0 and again.where(F.col("detail_level") == "compressed").count() == 6


def test_empty(spark, tmp_path):
    after, log = compression.compress(spark.createDataFrame([], SCHEMA), str(tmp_path), NOW)
    assert after.count() == 0 and log.count() == 0
