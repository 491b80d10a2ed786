"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.common import small_batches, stored

#: Hashed features; labelled rows that the fit uses at most; grades beyond 0; a document is toxic from this severity on.
FEATURES, SAMPLE, GRADES, TOXIC = 1 << 18, 20_000, 3, 0.5
#: Characters of a word that make a feature of their own, besides the whole word.
STEMS = (4, 5)
#: Log likelihood ratio from which a feature that toxic documents have more often is used.
EVIDENCE = 16.0

_WORD = re.compile(r"[^\W\d_]+")
_known: dict[str, tuple[int, ...]] = {}


def _hash(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 >> 17) % FEATURES


def _of_word(word: str) -> tuple[int, ...]:
    found = _known.get(word)
    if found is None:
        if len(_known) > 300_000:
            _known.clear()
        found = _known[word] = (_hash("w:" + word), *[_hash(f"p{k}:" + word[:k]) for k in STEMS if len(word) > k])
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: hashed lower-case words and their first letters, each log(1 + count)."""
    counts: dict[int, int] = {}
    words: dict[str, int] = {}
    for w in _WORD.findall((text or "").lower()):
        words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        for f in _of_word(w):
            counts[f] = counts.get(f, 0) + n
    at = np.fromiter(counts, np.int32, len(counts))
    return at, np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """P(grade > k) = sigmoid(w x - t_k): one weight vector shared by ordered thresholds t_0 < t_1 < ..."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def severity(self, at: np.ndarray, value: np.ndarray) -> float:
        """The expected grade: the sum of the chances to exceed each threshold."""
        return float(_sigmoid(self.weights[at] @ value - self.thresholds).sum())


def informative(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features toxic documents have more often than clean ones, by a log likelihood ratio of at least
    ``EVIDENCE``, from the documents of each kind that have them."""
    present, docs = np.stack([clean, toxic]).astype(float), np.array([[max(1, n_clean)], [max(1, n_toxic)]], float)
    rate, own = present.sum(axis=0) / docs.sum(), present / docs
    part = lambda seen, p: seen * np.log(np.maximum(p, 1e-12))
    ratio = 2 * (part(present, own) + part(docs - present, 1 - own) - part(present, rate) - part(docs - present, 1 - rate)).sum(axis=0)
    return (ratio >= EVIDENCE) & (own[1] > own[0])


def grades_of(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Ordered grades from 0 / 1 labels, and the features used. A toxic document's grade is 1 plus the tercile, among
    toxic documents, of its total of informative features."""
    present = np.zeros((2, FEATURES))
    for (at, _), y in zip(rows, toxic):
        present[int(y), at] += 1
    use = informative(present[1], present[0], int((toxic == 1).sum()), int((toxic == 0).sum()))
    load = np.array([value[use[at]].sum() for at, value in rows])
    edges = np.quantile(load[toxic == 1], np.arange(1, grades) / grades) if (toxic == 1).any() else np.zeros(grades - 1)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, load, "right"), 0), use


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = GRADES, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-4) -> CumulativeLink:
    """Maximum likelihood by full-batch Adam on the negative log likelihood of the grades, L2 on the weights."""
    y, use = grades_of(rows, toxic, grades)
    cols = np.flatnonzero(use)
    place = np.full(FEATURES, -1)
    place[cols] = np.arange(len(cols))
    kept = [(place[at[use[at]]], value[use[at]]) for at, value in rows]
    own = np.repeat(np.arange(len(kept)), [len(a) for a, _ in kept])
    at = np.concatenate([a for a, _ in kept]) if kept else np.zeros(0, int)
    value = np.concatenate([v for _, v in kept]) if kept else np.zeros(0)
    share = np.bincount(y, minlength=grades + 1) / max(1, len(y))
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-4, 1 - 1e-4)
    steps = -np.log(above / (1 - above))
    theta = np.concatenate([np.zeros(len(cols)), [steps[0]], np.log(np.maximum(np.diff(steps), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = np.arange(grades)
    for step in range(1, rounds + 1):
        w, t = theta[: len(cols)], _ordered(theta[len(cols) :])
        score = np.bincount(own, value * w[at], minlength=len(kept))
        c = _sigmoid(score[:, None] - t[None, :])
        ext = np.concatenate([np.ones((len(y), 1)), c, np.zeros((len(y), 1))], axis=1)
        p = np.maximum(ext[np.arange(len(y)), y] - ext[np.arange(len(y)), y + 1], 1e-12)
        slope = ext * (1 - ext)
        d_hi, d_lo = slope[np.arange(len(y)), y] / p, slope[np.arange(len(y)), y + 1] / p
        d_score = -(d_hi - d_lo) / len(y)
        d_t = np.zeros((len(y), grades + 2))
        d_t[np.arange(len(y)), y] += d_hi / len(y)
        d_t[np.arange(len(y)), y + 1] -= d_lo / len(y)
        d_t = d_t.sum(axis=0)[1:-1]
        g_w = np.bincount(at, value * d_score[own], minlength=len(cols)) + penalty * w
        rest = np.cumsum(d_t[::-1])[::-1]
        g = np.concatenate([g_w, [rest[0]], rest[1:] * np.exp(theta[len(cols) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[cols] = theta[: len(cols)]
    return CumulativeLink(weights, _ordered(theta[len(cols) :]))


def _ordered(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows (the first by a hash of the key), toxic and clean rows half each where
    there are enough. Spark counts the documents of each feature; the driver holds those counts for features in three
    documents or more, then the informative features of the sample, and nothing else of the corpus. A document is toxic
    if any of its labels says so; labels that are null, or of documents without a row, are left out; of rows that share
    a key the one with the least text counts; without toxic labels no document is toxic. The picked keys, ``sample`` at
    most, are sent to the scan, so that no other text is shuffled."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    half = sample // 2
    picked = stored(known.where("toxic = 1").orderBy(order).limit(half).unionByName(known.where("toxic = 0").orderBy(order).limit(half)), "toxic-picked")

    def told(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["toxic", "at", "value"])

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = stored(texts.select("text", "toxic").mapInArrow(told, "toxic int, at array<int>, value array<double>"), "toxic-features")
    n = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n[0]:
        return CumulativeLink(np.zeros(FEATURES), np.full(grades, 40.0))
    seen = rows.select("toxic", F.explode("at").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).where("t + c >= 3").toArrow()
    present = np.zeros((2, FEATURES))
    present[:, seen.column("f").to_numpy()] = [seen.column("c").to_numpy(), seen.column("t").to_numpy()]
    use = docs.sparkSession.sparkContext.broadcast(np.flatnonzero(informative(present[1], present[0], n[0], n[1])))

    def kept(batches):
        mask = np.zeros(FEATURES, bool)
        mask[use.value] = True
        for batch in batches:
            both = [(np.array(a, np.int32), np.array(v)) for a, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            both = [(a[mask[a]], v[mask[a]]) for a, v in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float64()))], names=["toxic", "at", "value"])

    small = rows.mapInArrow(kept, "toxic int, at array<int>, value array<double>").toArrow()
    each = [(np.array(a, np.int32), np.array(v, float)) for a, v in zip(small.column("at").to_pylist(), small.column("value").to_pylist())]
    return fit(each, small.column("toxic").to_numpy().astype(int), grades)


def score(docs: DataFrame, model: CumulativeLink, text: str = "text") -> DataFrame:
    """``docs`` plus severity (expected grade) and toxic. A null or empty text has no features and gets the severity of
    the thresholds alone; every row gets its own result; columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c in ("severity", "toxic")])
    sent = spark.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[np.flatnonzero(model.weights)], model.thresholds))
    at = docs.columns.index(text)

    def run(batches):
        places, values, thresholds = sent.value
        weights = np.zeros(FEATURES)
        weights[places] = values
        own = CumulativeLink(weights, thresholds)
        for batch in batches:
            s = [own.severity(*features(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([x >= TOXIC for x in s], pa.bool_())], names=[*batch.schema.names, "severity", "toxic"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, train(docs, labels)).select("doc_id", F.round("severity", 6).alias("severity"), "toxic")
