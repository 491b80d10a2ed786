import datetime as dt

import pytest
from pyspark.sql import functions as F

from memlake.functions import scoring as S

NOW = dt.datetime(2026, 3, 27, 12, 0)


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def salience(spark, kind, confidence, mentions, days, accessed=None):
    t = lambda d: F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(int(d * 24)))
    a = F.lit(None).cast("timestamp") if accessed is None else t(accessed)
    return one(spark, s=S.salience(F.lit(confidence), F.lit(kind), F.lit(mentions), t(days), a, NOW))


@pytest.mark.parametrize("kind, confidence, mentions, days, expected", [("professional_identity", "high", 10, 0, 0.7876), ("recurring_pattern", "medium", 12, 2, 0.4646), ("passing_reference", "high", 1, 59, 0.0006)])
def test_known_values(spark, kind, confidence, mentions, days, expected):
    assert salience(spark, kind, confidence, mentions, days) == expected


def test_fading(spark):
    assert salience(spark, "professional_identity", "high", 10, 0) == salience(spark, "professional_identity", "high", 10, 2200) > 0.5
    assert salience(spark, "recurring_pattern", "medium", 3, 4) > 0.1 > salience(spark, "recurring_pattern", "medium", 3, 180)
    assert salience(spark, "task_query", "medium", 1, 8.5) < 0.05
    assert salience(spark, "passing_reference", "medium", 1, 10) < 0.05
    assert salience(spark, "nonsense", "nonsense", None, 0) == salience(spark, "task_query", "medium", 1, 0)
    assert salience(spark, "task_query", "medium", 1, 8.5, accessed=0) > 0.15


def test_tiers_and_scores(spark):
    r = one(
        spark, a=S.stored_tier(F.lit(None).cast("int"), F.lit("recurring_pattern")), b=S.stored_tier(F.lit(3), F.lit("explicit_save")), c=S.search_tier(F.lit(2), F.lit(0.6)), d=S.search_tier(F.lit(2), F.lit(0.65)),
        e=S.source_weight(F.create_map(F.lit("email"), F.lit(0.6))), f=S.source_weight(F.create_map(F.lit("codex"), F.lit(1.0))), g=S.source_weight(F.lit(None).cast("map<string,double>"), F.lit("My Gmail")),
        h=S.final_score(F.lit(0.8), F.lit(1.0), F.lit(0.5), F.lit(1), F.lit(1.5)),
    )
    assert tuple(r) == (2, 3, 3, 2, 1.0, 1.5, 0.6, round((0.55 * 0.8 + 0.15 + 0.15) * 1.15 * 1.5, 4))


def test_text_helpers(spark):
    r = one(
        spark, a=S.comparable(F.lit("  Héllo, World!! ")), b=S.opposing(F.lit("stocks outperform"), F.lit("they underperform")), c=S.opposing(F.lit("a"), F.lit("b")), d=S.shortened(F.lit("x" * 10), 8),
        e=S.extreme_time(F.array(F.lit("2024-01-02T00:00:00Z"), F.lit("bad"), F.lit("2024-01-01")), True), f=S.to_int(F.lit("3.7")), g=S.to_int(F.lit("3.7"), truncate=False), h=S.to_int(F.lit("no"), 5),
        i=S.appended(F.array(F.lit("a"), F.lit("b")), F.lit("b"), 20), j=S.appended(F.array(F.lit("a"), F.lit("b")), F.lit("c"), 2), k=S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))),
    )
    assert tuple(r) == ("h llo world", "opposing markers (outperform vs underperform)", None, "xxxxx...", "2024-01-02T00:00:00Z", 3, 0, 5, ["a", "b"], ["b", "c"], 0.5)
