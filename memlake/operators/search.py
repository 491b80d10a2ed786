"""Similarity search over entry vectors with tier-aware ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake.functions.scoring import comparable, final_score, recency, search_tier, source_weight
from memlake.plans.pieces import pieces, rarest
from memlake.plans.tables import stored

HIT = "query_id long, vec_id long, similarity double"


def _nearest(asked: pa.Table, k: int, least: float):
    """The scan of vectors for one block of queries (id, v)."""
    ask = asked.column("id").to_pylist()
    rows = [np.array(v, float) for v in asked.column("v").to_pylist()]

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [np.array(v.values.to_numpy(zero_copy_only=False), float) for v in batch.column(1)]
            for w in {len(x) for x in found}:
                qs, vs = [i for i, x in enumerate(rows) if len(x) == w], [i for i, x in enumerate(found) if len(x) == w]
                if not qs:
                    continue
                a, b = np.stack([rows[i] for i in qs]), np.stack([found[i] for i in vs])
                size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                sim = np.where(size > 0, (a @ b.T) / np.where(size > 0, size, 1), 0.0)
                them = np.array([ids[i] for i in vs])
                for r, i in enumerate(qs):
                    s, t = sim[r][sim[r] >= least], them[sim[r] >= least]
                    if i in best:
                        s, t = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], t])
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        s, t = s[s >= edge], t[s >= edge]
                    o = np.lexsort((t, -s))[:k]
                    best[i] = s[o], t[o]
        for i, (s, t) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ask[i])), pa.array(t), pa.array(s)], names=["query_id", "vec_id", "similarity"])

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, least: float = -2.0, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, similarity): for each of ``queries`` (query_id, embedding) the ``k`` nearest vectors by cosine
    of at least ``least``; a vector without length has similarity 0; ties go to the smaller id.

    Vectors are scanned where they lie, once for each block of about ``block`` queries, which goes to all tasks; k rows a
    query leave a task. Vectors whose length differs from the query's are no candidates; null ones take no part, be they
    asked for or looked at."""
    of = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, v = of(queries, "query_id"), of(vectors, "vec_id")
    parts = max(1, -(-q.count() // block))
    near = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    out = None
    for b in range(parts):
        asked = q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).toArrow()
        found = v.mapInArrow(_nearest(asked, k, least), HIT).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r")
        out = found if out is None else out.unionByName(stored(found, "nearest"))
    return out


def search(hits: DataFrame, entries: DataFrame, now, limit: int = 5, tier: int | None = None) -> DataFrame:
    """Ranked entries for the over-fetched ``hits`` (query_id, vec_id, similarity): archived entries go, similarity can
    lower the tier, then tier, final score and similarity rank. With ``tier``, only that effective tier."""
    limit = max(1, min(limit, 20))
    live = entries.where(~F.coalesce("archived", F.lit(False)))
    df = hits.join(live, hits["vec_id"] == live["entry_id"])
    df = df.withColumn("effective_tier", search_tier(F.col("tier"), F.col("similarity")))
    if tier:
        df = df.where(F.col("effective_tier") == tier)
    weight = source_weight(F.col("source_weights")) if "source_weights" in entries.columns else F.lit(1.0)
    df = df.withColumn("final_score", final_score(F.col("similarity"), recency(F.col("updated_at"), F.lit(now).cast("timestamp")), F.col("salience"), F.col("effective_tier"), weight))
    order = W.partitionBy("query_id").orderBy("effective_tier", F.col("final_score").desc(), F.col("similarity").desc(), "vec_id")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "entry_id", "effective_tier", "final_score", "similarity")


def over_fetch(limit: int) -> int:
    return min(max(1, min(limit, 20)) * 8, 60)


def best_context(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Of each query's five nearest hits the first whose entry is there and not archived."""
    five = hits.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id"))).where("r <= 5")
    live = entries.where(~F.coalesce("archived", F.lit(False))).select("entry_id")
    found = five.join(live, five["vec_id"] == live["entry_id"]).withColumn("p", F.row_number().over(W.partitionBy("query_id").orderBy("r")))
    return found.where("p = 1").select("query_id", "entry_id", "similarity")


def label_match(asked: Column, label: Column) -> Column:
    """1 for an equal label, 2 where the label holds the words asked for, 3 where each stands in some word of it; else null."""
    a, b = comparable(asked), comparable(label)
    inside = F.forall(F.split(a, " "), lambda w: b.contains(w))
    return F.when(a == b, 1).when(b.contains(a), 2).when(inside, 3)


def labels_matching(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, doc_id, rank) of questions (item_id, asked) and labels (doc_id, label) that ``label_match``; a question
    without words meets labels without words only.

    Questions and labels are compared as comparable texts, each once however many rows have it. Every word asked for
    stands in the label, so a question meets labels by that piece of its words, of three signs or as many as its longest
    word has, that the fewest labels hold."""
    questions = stored(asked.select("item_id", comparable(F.col("asked")).alias("q")), "questions")
    said = stored(labels.select("doc_id", comparable(F.col("label")).alias("l")), "labels")
    all_of = lambda text: F.concat(pieces(text, 1), pieces(text, 2), pieces(text, 3))
    words = F.split("q", " ")
    longest = F.least(F.lit(3), F.array_max(F.transform(words, F.length)))
    own = F.array_distinct(F.flatten(F.transform(words, all_of)))
    mine = questions.select("q").distinct().where("q <> ''").select("q", F.explode(F.filter(own, lambda p: F.length(p) == longest)).alias("piece"))
    held = said.select("l").distinct().select("l", F.explode(all_of(F.col("l"))).alias("piece"))
    met = held.join(rarest(mine, held, "q"), "piece").withColumn("rank", label_match(F.col("q"), F.col("l"))).where("rank is not null").select("q", "l", "rank")
    bare = questions.where("q = ''").select("q").distinct().select("q", F.col("q").alias("l"), F.lit(1).alias("rank"))
    return questions.join(met.unionByName(bare), "q").join(said, "l").select("item_id", "doc_id", "rank")
