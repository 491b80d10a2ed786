"""Pairs of texts of one key, met block by block, and how many words they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Texts and signs of a block; texts of whole groups that are cut into words at once.
BLOCK, SIGNS, CUT = 1024, 6_000_000, 1024
#: A shared word is counted by a matrix product where it makes one of so many pairs or more, else match by match; columns
#: of a product, and matches that are listed at a time.
DENSE, COLUMNS, MATCHES = 200, 4096, 2_000_000


def in_blocks(df: DataFrame, key: str, text: str, other: str) -> DataFrame:
    """Rows dealt by hash into blocks of their key, each with its own and every other block: columns i <= j, and whether
    the row is of j (``second``). A group (key, i, j) lies in one partition, in order of text and other; any two rows of
    a key meet in exactly one. The table is read twice, so it should be stored."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length(text)).alias("__signs"))
    sizes = sizes.where("__n > 1").select(F.struct(key).alias("__key"), F.greatest(F.ceil(F.col("__n") / BLOCK), F.ceil(F.col("__signs") / SIGNS)).alias("__blocks"))
    df = df.withColumn("__key", F.struct(key)).join(sizes.hint("shuffle_hash"), "__key").drop("__key")
    own, met = F.pmod(F.xxhash64(text, other), F.col("__blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))
    df = df.withColumn("__own", own).withColumn("__met", met)
    df = df.withColumns({"i": F.least("__own", "__met"), "j": F.greatest("__own", "__met"), "second": F.col("__own") > F.col("__met")}).drop("__blocks", "__own", "__met")
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", text, other)


def whole_groups(batches, keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted batches as ones of whole groups, of about CUT rows at least where there are so many, and where groups begin
    and the last one ends. One group and a batch are held."""
    held, last, rows = [], None, 0

    def joined(parts):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return table, [0, *_changes(table, keys), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _changes(batch, keys)
        first = [batch.column(k)[0].as_py() for k in keys]
        if last is not None and first != last:
            ends = [0, *ends]
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        at = 0
        for end in ends:
            if rows + end - at >= CUT or end == ends[-1]:
                if end > at:
                    held.append(batch.slice(at, end - at))
                if held:
                    yield joined(held)
                held, rows, at = [], 0, end
        held.append(batch.slice(at))
        rows += batch.num_rows - at
    if held:
        yield joined(held)


def _changes(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[int]:
    """Rows that differ from the one before in a key."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return (np.flatnonzero(new) + 1).tolist()


class Words:
    """The word sets of comparable texts: of each text its words' numbers, sorted, one after the other."""

    def __init__(self, texts):
        parts = pc.split_pattern(texts, " ")
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        self.n, self.texts = max(len(coded.dictionary), 1), len(texts)
        key = np.sort(text[there] * self.n + word[there])
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        text, self.word = np.divmod(key, self.n)
        self.size = np.bincount(text, minlength=self.texts)
        self.start = np.append(0, np.cumsum(self.size))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, word) of all their words, by place."""
        size = self.size[rows]
        at = np.repeat(self.start[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.word[at]


def common(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words each text of ``a`` shares with each of ``b``. Words that many pairs share are counted by a product
    of 0 / 1 matrices (exact: counts are far below 2**24), the others match by match."""
    (ta, wa), (tb, wb) = words.of(a), words.of(b)
    n = words.n
    if 8 * (len(wa) + len(wb)) < n:
        told, place = np.unique(np.concatenate([wa, wb]), return_inverse=True)
        wa, wb, n = place[: len(wa)], place[len(wa) :], max(len(told), 1)
    held = np.bincount(wb, minlength=n)
    both = np.bincount(wa, minlength=n) * held
    dense = (both > 0) & (both * DENSE >= len(a) * len(b))
    column = np.cumsum(dense) - 1
    out = np.zeros((len(a), len(b)), np.float32)
    da, db = dense[wa], dense[wb]
    sides = (len(a), ta[da], column[wa[da]]), (len(b), tb[db], column[wb[db]])
    for first in range(0, int(dense.sum()), COLUMNS):
        one = []
        for rows, t, c in sides:
            now = (c >= first) & (c < first + COLUMNS)
            one.append(m := np.zeros((rows, min(COLUMNS, int(dense.sum()) - first)), np.float32))
            m[t[now], c[now] - first] = 1
        out += one[0] @ one[1].T
    rare = (both > 0) & ~dense
    ta, wa, tb, wb = ta[x := rare[wa]], wa[x], tb[y := rare[wb]], wb[y]
    if len(wa):
        tb = tb[np.argsort(wb, kind="stable")]
        held = np.where(rare, held, 0)
        start, many = np.cumsum(held) - held, held[wa]
        done = np.append(0, np.cumsum(many))
        at = 0
        while at < len(wa):
            to = max(at + 1, int(np.searchsorted(done, done[at] + MATCHES, "right")) - 1)
            k = many[at:to]
            other = tb[np.repeat(start[wa[at:to]] - (done[at:to] - done[at]), k) + np.arange(k.sum())]
            low, high = ta[at], ta[to - 1] + 1
            out[low:high] += np.bincount(np.repeat(ta[at:to] - low, k) * len(b) + other, minlength=(high - low) * len(b)).reshape(high - low, len(b))
            at = to
    return out
