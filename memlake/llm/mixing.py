"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks a shard, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memlake.llm.common import SPACE, WORD, names_kept, stored, words_of

#: Weights that the sources take in turn, in code point order.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK, SHARD_DOCS, SEED = 64, 4096, 17
#: A source whose target has fewer blocks than these is settled in smaller blocks of its own, so many of them.
FEW = 100
#: Block steps; primes above any number of blocks, so that j -> (step * j + offset) mod m is a permutation.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, ...) -> plus weight and target: ``share`` of all sizes dealt by weight, none above
    ``cap`` times its source, the excess reshared. Sorting by size / weight makes the resharing one running sum:
    a source is full exactly if the level left for it and all later ones reaches its cap. One row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    df = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    df = df.withColumn("level", (total - before) / rest)
    df = df.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), "level"))).over(W.partitionBy())["level"]
    return df.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).drop("cap", "level", "full")


def sainte_lague(votes: DataFrame, house: str, key: str | None = None) -> DataFrame:
    """Add ``seats``: the ``house`` seats of each group ``key`` go to the highest quotients votes / (2 k + 1).

    ``votes`` has columns id, votes and the group's ``house`` on each row. Rounding votes / divisor gives every seat
    but a few; only quotients near that border are then ranked: a row's seats can differ from its rounded share by
    no more than its share of (missing seats + rows) plus one, so the ranked rows stay in proportion to the rows.
    Ties go to the smaller id; rows without votes get no seat."""
    group = W.partitionBy(key) if key else W.partitionBy()
    df = votes.withColumn("__all", F.sum("votes").over(group)).withColumn("__rows", F.count(F.lit(1)).over(group))
    fair = F.when(F.col("__all") > 0, F.col("votes") * F.col(house) / F.col("__all")).otherwise(F.lit(0.0))
    df = df.withColumn("__low", F.floor(fair + 0.5).cast("long"))
    df = df.withColumn("__gap", F.col(house) - F.sum("__low").over(group))
    near = F.ceil(F.col("votes") / F.col("__all") * (F.abs("__gap") + F.col("__rows"))).cast("long") + 1
    more = F.when((F.col("__gap") > 0) & (F.col("votes") > 0), F.sequence(F.col("__low"), F.col("__low") + near - 1))
    less = F.when((F.col("__gap") < 0) & (F.col("__low") > 0), F.sequence(F.greatest(F.lit(0), F.col("__low") - near), F.col("__low") - 1))
    df = df.withColumn("__k", F.explode_outer(F.coalesce(more, less))).withColumn("__q", F.col("votes") / (2 * F.col("__k") + 1))
    order = (W.partitionBy(key) if key else W.partitionBy()).orderBy(
        F.col("__k").isNull(), F.when(F.col("__gap") > 0, -F.col("__q")).otherwise(F.col("__q")), F.when(F.col("__gap") > 0, F.col("id")).otherwise(-F.col("id"))
    )
    df = df.withColumn("__won", (F.col("__k").isNotNull() & (F.row_number().over(order) <= F.abs("__gap"))).cast("long"))
    keys = [c for c in votes.columns]
    return df.groupBy(*keys).agg((F.first("__low") + F.signum(F.first("__gap")).cast("long") * F.sum("__won")).cast("long").alias("seats"))


def seeded(*cols, seed: int = SEED) -> F.Column:
    """A 60-bit hash of columns and seed; the same in any engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@names_kept
def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """Mix documents given as (doc_id, source, size) and, if there, ``print``, a hash of the text: add source_size,
    target, taken and ``picks``, an array of (first word, end, times) of the document's words that the mix takes.

    Shards of about ``shard_docs`` documents of one source lie in seeded order as one stream of words, cut into equal
    blocks of ``block`` words. Each source's blocks and then each shard's are Sainte-Lague quotas; a source whose target
    is under ``FEW`` blocks has its target dealt in ``FEW`` smaller blocks instead, which changes no other source; a shard takes quota div blocks of every block and one more of those
    that a seeded permutation puts first. A null source is a source; repeated rows are documents of their own; with
    no words at all every target is 0; an empty table gives an empty table. A hot source only has more shards."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    goal = targets(sources, weights, share, cap)
    unit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / FEW))).cast("long")
    goal = goal.withColumns({"__unit": unit, "__house": F.floor(F.sum("target").over(W.partitionBy()) / block + 0.5).cast("long")})
    goal = goal.withColumns({"id": F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())), "votes": F.col("target")})
    own = F.when(F.col("__unit") < block, F.floor(F.col("target") / F.col("__unit") + 0.5).cast("long")).otherwise(F.col("seats"))
    goal = stored(sainte_lague(goal, "__house").select("source", "source_size", "target", "__unit", own.alias("__blocks"), F.ceil(F.col("__docs") / shard_docs).cast("long").alias("__shards"), F.col("id").alias("__sid")), "mix-goal")
    docs = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    docs = docs.withColumn("__h", seeded("doc_id", "size", *[c for c in ("print",) if c in sized.columns], seed=seed)).withColumn("__shard", F.col("__h") % F.col("__shards"))
    stream = W.partitionBy("__sid", "__shard")
    at = F.sum("size").over(stream.orderBy("__h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0))
    docs = docs.withColumns({"__b": at, "__v": F.sum("size").over(stream)}).withColumn("__a", F.col("__b") - F.col("size"))
    shards = docs.where("size > 0").groupBy("__sid", "__shard").agg(F.sum("size").alias("votes"), F.first("__blocks").alias("__blocks"), F.first("__unit").alias("__u"))
    quotas = sainte_lague(shards.withColumn("id", F.col("__shard")), "__blocks", "__sid")
    m = F.ceil(F.col("votes") / F.col("__u")).cast("long")
    quotas = quotas.select("__sid", "__shard", m.alias("__m"), F.least(F.col("seats"), cap * m).alias("__q"))
    quotas = quotas.withColumn("__o", seeded("__sid", "__shard", seed=seed)).withColumn("__step", F.element_at(F.array(*[F.lit(s).cast("long") for s in STEPS]), (F.col("__o") % len(STEPS) + 1).cast("int")))
    docs = docs.join(quotas, ["__sid", "__shard"], "left")
    edge = lambda j: F.floor(j * F.col("__v") / F.col("__m")).cast("long")
    first = F.floor((F.col("__a") + 1) * F.col("__m") / F.col("__v")).cast("long")
    blocks = F.sequence(F.greatest(F.lit(0).cast("long"), first - 2), F.least(F.col("__m") - 1, F.floor(F.col("__b") * F.col("__m") / F.col("__v")).cast("long") + 1))
    times = lambda j: F.floor(F.col("__q") / F.col("__m")).cast("long") + (F.pmod(F.col("__step") * j + F.pmod("__o", "__m"), F.col("__m")) < F.pmod("__q", "__m")).cast("long")
    pick = lambda j: F.struct(
        (F.greatest(edge(j), F.col("__a")) - F.col("__a")).alias("first"), (F.least(edge(j + 1), F.col("__b")) - F.col("__a")).alias("end"), times(j).alias("times")
    )
    picks = F.when((F.col("size") > 0) & (F.col("__q") > 0), F.filter(F.transform(blocks, pick), lambda p: (p["end"] > p["first"]) & (p["times"] > 0)))
    docs = docs.withColumn("picks", F.coalesce(picks, F.array().cast("array<struct<first:bigint,end:bigint,times:bigint>>")))
    docs = docs.withColumn("taken", F.aggregate("picks", F.lit(0).cast("long"), lambda s, p: s + (p["end"] - p["first"]) * p["times"]))
    return docs.drop(*[c for c in docs.columns if c.startswith("__")])


def _count(text: F.Column) -> F.Column:
    return F.size(words_of(text)).cast("long")


def _print(text: F.Column) -> F.Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, print): words of every whole text, 0 for null, and a hash of it, so that documents that
    share an id, or have none, still spread over shards."""
    return docs.select("doc_id", "source", _count(F.col("text")).alias("size"), _print(F.col("text")).alias("print"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(stored(sizes(docs), "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


def taken_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass over a document that takes any of its words, its text cut to the
    words taken in that pass (with the white space that follows them), its other columns as they were. Rows of equal
    key, source and text are told apart by rank: their takings differ by their place in the stream only."""
    key = ["doc_id", "source", "size", "print"]
    sized = stored(sizes(docs), "mix-sizes")
    n = F.row_number().over(W.partitionBy(*key).orderBy("picks"))
    picks = mix(sized, **options).select(*key, F.col("picks").alias("__picks"), n.alias("__m")).where(F.size("__picks") > 0)
    rows = docs.withColumns({"__size": _count(F.col("text")), "__print": _print(F.col("text"))})
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "source", "__size", "__print").orderBy("text")))
    on = rows["__n"] == picks["__m"]
    for a, b in (("doc_id", "doc_id"), ("source", "source"), ("__size", "size"), ("__print", "print")):
        on = on & rows[a].eqNullSafe(picks[b])
    df = rows.join(picks, on).select(*[rows[c] for c in docs.columns], picks["__picks"])
    df = df.withColumn("__w", F.regexp_extract_all("text", F.lit(f"{WORD}(?:{SPACE})?"), F.lit(0)))
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform("__picks", lambda p: p["times"])).cast("int")))
    df = df.withColumn("__pass", F.explode(passes))
    kept = F.filter("__picks", lambda p: p["times"] >= F.col("__pass"))
    text = F.array_join(F.flatten(F.transform(kept, lambda p: F.slice("__w", (p["first"] + 1).cast("int"), (p["end"] - p["first"]).cast("int")))), "")
    df = df.withColumn("text", text)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def _hash_sql(*values: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(values)} || '|{SEED}'), 1, 15))::BIGINT"


OP5_SQL = f"""
WITH z AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, substr(md5(coalesce(text, '')), 1, 16) AS print FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, [3, 1, 2][((sid - 1) % 3 + 1)::INTEGER] AS w, {float(CAP)}::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, source_size::DOUBLE / w AS o, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, first_value(level) OVER (ORDER BY cap <= level * w, o) AS lam FROM s3),
s5 AS (SELECT source, source_size, docs, sid, CASE WHEN cap <= level * w THEN cap ELSE lam * w END AS target FROM s4),
s6 AS (SELECT *, greatest(1, least({BLOCK}, floor(target / {FEW})))::BIGINT AS unit, sum(target) OVER () AS total FROM s5),
s7 AS (SELECT *, floor(total / {BLOCK} + 0.5)::BIGINT AS house FROM s6),
q1 AS (SELECT sid, house, target / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, floor(target / {BLOCK})::BIGINT + 8)) AS k FROM s7 WHERE target > 0)),
q2 AS (SELECT sid, row_number() OVER (ORDER BY q DESC, sid) AS r, house FROM q1),
g AS (SELECT s7.*, CASE WHEN unit < {BLOCK} THEN floor(target / unit + 0.5)::BIGINT ELSE coalesce(n, 0) END AS blocks, ceil(docs / {SHARD_DOCS}.0)::BIGINT AS shards FROM s7 LEFT JOIN (SELECT sid, count(*) AS n FROM q2 WHERE r <= house GROUP BY sid) USING (sid)),
d0 AS (SELECT z.*, g.sid, g.source_size, g.target, g.unit, g.blocks, g.shards, {_hash_sql("coalesce(doc_id::VARCHAR, '~')", "size::VARCHAR", "print")} AS h FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
d1 AS (SELECT *, h % shards AS shard FROM d0),
d2 AS (SELECT *, sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS b, sum(size) OVER (PARTITION BY sid, shard)::BIGINT AS v FROM d1),
t0 AS (SELECT sid, shard, any_value(v) AS v, any_value(blocks) AS blocks, any_value(unit) AS unit, sum(any_value(v)) OVER (PARTITION BY sid) AS vs FROM d2 WHERE size > 0 GROUP BY sid, shard),
t1 AS (SELECT sid, shard, blocks, v / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, floor(v * blocks / vs)::BIGINT + 8)) AS k FROM t0)),
t2 AS (SELECT sid, shard, blocks, row_number() OVER (PARTITION BY sid ORDER BY q DESC, shard) AS r FROM t1),
t3 AS (SELECT t0.sid, t0.shard, ceil(v::DOUBLE / unit)::BIGINT AS m, coalesce(n, 0) AS seats, {_hash_sql("t0.sid::VARCHAR", "t0.shard::VARCHAR")} AS o FROM t0 LEFT JOIN (SELECT sid, shard, count(*) AS n FROM t2 WHERE r <= blocks GROUP BY 1, 2) USING (sid, shard)),
t4 AS (SELECT *, least(seats, {CAP} * m) AS q, {list(STEPS)}[(o % {len(STEPS)} + 1)::INTEGER]::BIGINT AS step FROM t3),
p AS (SELECT rid, sum(greatest(0, least((j + 1) * v // m, b) - greatest(j * v // m, b - size)) * (q // m + CASE WHEN (step * j + o % m) % m < q % m THEN 1 ELSE 0 END)) AS taken
  FROM (SELECT rid, b, v, size, m, q, o, step, unnest(range(greatest(0, (b - size) * m // v - 1), least(m, b * m // v + 2))) AS j FROM d2 JOIN t4 USING (sid, shard) WHERE size > 0) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d2 LEFT JOIN p USING (rid)
"""
