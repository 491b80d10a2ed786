"""Hard negatives by bounds along a spanning tree of the anchors: only candidates whose bounds meet a window are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memlake.llm.common import small_batches, stored
from memlake.plans.tables import numbered

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST_SHARE = 80
#: Anchors of one tree; components of the candidates that a task holds (32 MB as doubles), and candidates that are bounded
#: at a time (with a tree's bounds 32 MB).
TREE, HELD, BOUNDED = 1024, 4_194_304, 2048
#: Doubles tell integers apart up to here; beyond, products are Python's.
EXACT = 2**53
LOW = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, scale: int = SCALE, every: int = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """(row, vec_id, label, v): a number of the row, its label and floor(scale * x) of every component. Rows with a null
    label or vector, or a null or non-finite component, go; rows whose id is a multiple of ``every`` get the next label.
    Repeated and null ids stay, as rows are told by number. Stored, so that numbers are the same in every scan."""
    x, i = F.col("embedding"), F.col("vec_id").cast("long")
    usable = x.isNotNull() & F.col("label").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.coalesce(i % every == 0, F.lit(False)), F.pmod(label + 1, F.lit(labels))).otherwise(label)
    used = vectors.where(F.coalesce(usable, F.lit(False)))
    return stored(used.select(F.monotonically_increasing_id().alias("row"), i.alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")), "negative-rows")


def matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones ending in zeros, which no product minds."""
    off, flat = rows.offsets.to_numpy(), rows.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(off)
    out = np.zeros((len(sizes), width))
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], sizes)] = flat
    return out


def products(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of rows with one vector."""
    if exact:
        return np.rint(left @ right).astype(np.int64)
    whole = [int(x) for x in right]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in left], object).astype(np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a least spanning tree grown from the point nearest to the mean. ``order`` has parents
    first, ``parent`` is a place in it (-1 for the root), ``edge`` the distance, rounded up."""
    n = len(points)
    near = np.argmin(((points - points.mean(0)) ** 2).sum(1))
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    least, by, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    for at in range(n):
        pick = near if at == 0 else int(np.argmin(np.where(free, least, np.inf)))
        order[at], parent[at], free[pick] = pick, by[pick], False
        edge[at] = 0.0 if at == 0 else np.sqrt(least[pick]) * (1 + 1e-9)
        away = ((points - points[pick]) ** 2).sum(1)
        closer = free & (away < least)
        least[closer], by[closer] = away[closer], at
    return order, parent, edge


def trees(anchors: DataFrame, size: int = TREE) -> DataFrame:
    """Anchors (row, vec_id, label, v) with tree, at, parent, edge: dealt in trees of ``size``, those of a label together
    as they are likely to be near each other, and joined to a spanning tree each. Stored."""
    placed = numbered(anchors, [F.col("label"), F.col("row")]).withColumn("tree", F.floor((F.col("place") - 1) / size)).drop("place")

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = table.column("v").combine_chunks()
        order, parent, edge = spanning_tree(matrix(v, int(max(np.diff(v.offsets.to_numpy()), default=0))))
        table = table.take(pa.array(order))
        return table.append_column("at", pa.array(np.arange(len(order)))).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))

    out = "row long, vec_id long, label long, v array<long>, tree long, at long, parent long, edge double"
    return stored(placed.select("row", "vec_id", "label", "v", "tree").groupBy("tree").applyInArrow(grow, out), "negative-trees")


class Found:
    """The best candidates of one window so far: score descending, id ascending, null ids last."""

    def __init__(self, low: int, high: int, most: int):
        self.low, self.high, self.most = low, high, most
        self.score, self.pick = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a candidate must score to be of use."""
        return max(self.low, int(self.score[-1])) if len(self.score) == self.most else self.low

    def add(self, score: np.ndarray, pick: np.ndarray, rank: np.ndarray) -> None:
        ok = (score >= self.least()) & (score <= self.high)
        if ok.any():
            score, pick = np.concatenate([self.score, score[ok]]), np.concatenate([self.pick, pick[ok]])
            first = np.lexsort((rank[pick], -score))[: self.most]
            self.score, self.pick = score[first], pick[first]


def search_tree(tree: dict, held: dict, windows: list[list[Found]], same: bool, told: list | None = None) -> None:
    """Fill the windows of a tree's anchors from the candidates held.

    A score lies within the parent's bounds plus or minus edge length times the candidate's norm, by the inequality of
    Cauchy and Schwarz; a score that was worked out bounds from itself. Only candidates of the wanted kind whose bounds
    meet one of the anchor's windows are scored. Windows close from below as they fill."""
    points, n = tree["points"], len(held["row"])
    exact = float(np.sqrt((points**2).sum(1)).max(initial=0)) * float(held["norm"].max(initial=0)) < EXACT
    for a in range(0, n, BOUNDED):
        part = slice(a, min(a + BOUNDED, n))
        x, norm, row, label = held["points"][part], held["norm"][part], held["row"][part], held["label"][part]
        low, high = np.empty((len(points), len(x))), np.empty((len(points), len(x)))
        for at in range(len(points)):
            p = tree["parent"][at]
            if p < 0:
                lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
            else:
                slack = tree["edge"][at] * norm
                lo, hi = low[p] - slack, high[p] + slack
            if p >= 0:
                meets = np.zeros(len(x), bool)
                for w in windows[at]:
                    meets |= (hi >= w.least()) & (lo <= w.high)
                meets &= (label == tree["label"][at]) == same
                ask = np.flatnonzero(meets)
            else:
                ask = np.arange(len(x))
            if len(ask):
                score = products(x[ask], points[at], exact)
                lo[ask] = hi[ask] = score
                of_use = (label[ask] == tree["label"][at]) == same
                if same:
                    of_use &= row[ask] != tree["row"][at]
                for w in windows[at]:
                    w.add(score[of_use], a + ask[of_use], held["rank"])
            if told is not None:
                told.append((len(ask), len(x)))
            low[at], high[at] = lo, hi


RESULT = "arow long, nth int, row long, vec_id long, score long"
SCHEMA = pa.schema([("arow", pa.int64()), ("nth", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(same: bool, most: int):
    """Over rows sorted by split, candidates first, then anchors by tree and place: holds a split's candidates and one
    tree at a time."""

    def candidates(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        v = table.column("v").combine_chunks()
        width = int(max(np.diff(v.offsets.to_numpy()), default=0))
        ids = table.column("vec_id")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        points = matrix(v, width)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((table.column("row").to_numpy(), ids, ~known))] = np.arange(len(ids))
        return {"points": points, "norm": np.sqrt((points**2).sum(1)) * (1 + 1e-9), "row": table.column("row").to_numpy(), "label": table.column("label").to_numpy(), "id": ids, "known": known, "rank": rank}

    def found(parts, held):
        table = pa.Table.from_batches(parts).combine_chunks()
        scores = table.column("scores").to_pylist()
        tree = {k: table.column(k).to_numpy() for k in ("row", "label", "parent", "edge")}
        width = held["points"].shape[1]
        v = table.column("v").combine_chunks()
        whole = matrix(v, max(width, int(max(np.diff(v.offsets.to_numpy()), default=0))))
        tree["points"] = whole[:, :width]  # what goes beyond the candidates' components meets zeros; edges over it only widen bounds
        windows = [[Found(LOW + 1, np.iinfo(np.int64).max, most)] if same else [Found(-(-LEAST_SHARE * s // 100), s, most) for s in of] for of in scores]
        search_tree(tree, held, windows, same)
        rows = [(arow, nth, w) for arow, of in zip(tree["row"], windows) for nth, w in enumerate(of) if len(w.pick)]
        if rows:
            sizes = [len(w.pick) for _, _, w in rows]
            pick = np.concatenate([w.pick for _, _, w in rows])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([r[0] for r in rows], sizes)), pa.array(np.repeat([r[1] for r in rows], sizes).astype(np.int32)),
                pa.array(held["row"][pick]), pa.array(held["id"][pick], mask=~held["known"][pick]), pa.array(np.concatenate([w.score for _, _, w in rows])),
            ], schema=SCHEMA)

    def run(batches):
        now, parts, held = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = (int(keys[0][a]), int(keys[1][a])) if b > a else now
                if key != now:
                    if parts and now[1] < 0:
                        held = candidates(parts)
                    elif parts and held is not None:
                        yield from found(parts, held)
                    if now is not None and key[0] != now[0]:
                        held = None
                    now, parts = key, []
                if b > a:
                    parts.append(batch.slice(a, b - a))
        if parts and now[1] >= 0 and held is not None:
            yield from found(parts, held)

    return run


def searched(trees_: DataFrame, candidates: DataFrame, same: bool, most: int) -> DataFrame:
    """(arow, nth, row, vec_id, score): of every anchor and window the best ``most`` candidates of the anchor's label
    (``same``; one open window) or of the others (a window for each of ``scores``), of all candidates.

    Candidates are dealt into splits of bounded size by a hash of their row and shuffled once; to each split go all
    trees, so neither side is broadcast or brought to the driver, whatever the number of anchors."""
    spark = candidates.sparkSession
    small_batches(spark, 2048)
    n, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    splits = max(1, -(-n * max(width, 1) // HELD), min(spark.sparkContext.defaultParallelism, -(-n // BOUNDED)))
    scores = F.col("scores") if "scores" in trees_.columns else F.array().cast("array<long>")
    none = F.lit(None)
    held = candidates.select(F.pmod(F.xxhash64("row"), F.lit(splits)).alias("split"), F.lit(-1).cast("long").alias("tree"), F.col("row").alias("at"), "row", "vec_id", "label", "v", none.cast("long").alias("parent"), none.cast("double").alias("edge"), none.cast("array<long>").alias("scores"))
    asked = trees_.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("split"), "tree", "at", "row", "vec_id", "label", "v", "parent", "edge", scores.alias("scores"))
    both = held.unionByName(asked).repartition(splits, "split").sortWithinPartitions("split", "tree", "at")
    found = both.select("split", "tree", "row", "vec_id", "label", "v", "parent", "edge", "scores").mapInArrow(_search(same, most), RESULT)
    best = W.partitionBy("arow", "nth").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``anchors``, rows of ``rows``
    (row, vec_id, label, v): for each of an anchor's first ``positives`` other rows of its label the first ``negatives``
    rows of other labels that score at least 80 hundredths of the positive and no more than it.

    Higher scores come first, ties by smaller id, then by row; null ids come last. A positive with a negative score has
    no such rows. Repeated anchors and rows each count. Vectors of other lengths score over the components they share.
    Empty tables give an empty result. A score beyond 64 bits fails the query. Exact: bounds only save work."""
    tree = trees(anchors)
    first = stored(searched(tree, rows, True, positives), "negative-positives")
    of = first.groupBy(F.col("arow").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    # Anchors without a positive stay, for the tree hangs together by them.
    asked = tree.join(of, "row", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<long>")))
    found = searched(asked, rows, False, negatives)
    pair = first.select("arow", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("arow", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pair, ["arow", "nth"])
    out = out.join(anchors.select(F.col("row").alias("arow"), F.col("vec_id").alias("anchor_id")), "arow")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHOR_EVERY == 0))


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid AS other, c.vec_id, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.rid <> c.rid),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS nth FROM s WHERE same),
n AS (SELECT p.rid, p.nth, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other)::INTEGER AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
