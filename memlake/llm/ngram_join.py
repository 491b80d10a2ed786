"""N-gram Jaccard join: exact links between shingle sets by keyed candidates and dual traversal of signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.common import connected_components, small_batches, stored

#: Words a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Bytes of text hashed at a time, and shingles that a task may hold of one side of a block pair.
CHUNK_BYTES, BLOCK_SHINGLES = 4_000_000, 3_000_000
#: Documents a leaf and nodes a parent of a signature tree; node pairs bounded at a time.
FAN, FRONTIER = 8, 20_000

_U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BYTE[65:91] = _BYTE[97:123]
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | _U(1)
_SHORT = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, size: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < size:
        p = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's shingles: words between ASCII white space, A-Z lowered, five
    at a time; all words as one where there are fewer; empty without words or text. All texts are hashed at once."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        out += _sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi
    return out


def _sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n, none = len(off) - 1, np.zeros(0, np.int64)
    value = _BYTE[data]
    word = value != 0
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return [none] * n
    w = np.add.reduceat(value * _power(_STEP, len(data), "step"), starts) * _power(_BACK, len(data), "back")[starts]
    w = _mixed(w)
    first = np.searchsorted(starts, off)
    s = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        s += w[k : k + len(s)] * _PLACE[k]
    s = _mixed(s).view(np.int64)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        size = b - a
        if size >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif size:
            h = _SHORT[size]
            for k in range(size):
                h = _mixed((h ^ w[a + k : a + k + 1]) * _PLACE[k])
            out.append(h.view(np.int64))
        else:
            out.append(none)
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set; copies, whatever their white space or case, share it."""
    if not len(s):
        return 0
    u = s.view(np.uint64)
    one, two = np.add.reduce(_mixed(u), keepdims=True), np.add.reduce(_mixed(u ^ _STEP), keepdims=True)
    return int(_mixed(one ^ (two * _STEP + _U(len(s)))).view(np.int64)[0])


def overlap_needed(n: int) -> int:
    """Shingles that a set of ``n`` must have in common with any partner."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    """Of a set in hash order, how many shingles hold ``shared_needed`` of those common with any partner, in both."""
    return n - overlap_needed(n) + -(-n // 16)


def shared_needed(n: int) -> int:
    return -(-overlap_needed(n) // 16)


TRIPLE = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])
#: The same with a hash of the text, for rows of documents.
PREFIX = TRIPLE.append(pa.field("t", pa.int64()))
PREFIX_DDL = "key long, node long, n int, t long"


def _prefixes(batches):
    """Rows (shingle, set, 0) of every document's prefix, and (doc_id, set, size, hash) or size -1 for the document itself.
    A task leaves out prefixes of sets that it has told already."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        key, node, size, doc, doc_node, doc_size = [], [], [], [], [], []
        for i, s in zip(ids, shingle_sets(batch.column(1))):
            own = set_id(s)
            doc.append(i)
            doc_node.append(own)
            doc_size.append(len(s) or -1)
            if len(s) and own not in seen:
                if len(seen) < 1_000_000:
                    seen.add(own)
                p = s[: prefix_length(len(s))]
                key.append(p)
                node.append(np.full(len(p), own, np.int64))
        if key:
            k = np.concatenate(key)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.concatenate(node)), pa.array(np.zeros(len(k), np.int32)), pa.nulls(len(k), pa.int64())], schema=PREFIX)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(doc_node, pa.int64()), pa.array(doc_size, pa.int32()), batch.column(2)], schema=PREFIX)


def _shared(batches):
    """From prefix rows sorted by shingle and set: (set, set, count) of shingles that another set has too; rows of
    documents pass. A shingle's rows are looked at as they stream by; only its first set is remembered."""
    key_now, first, told = None, 0, True
    for batch in batches:
        key, node, n = (batch.column(i) for i in range(3))
        n = n.to_numpy()
        docs = np.flatnonzero(n != 0)
        if len(docs):
            yield batch.take(pa.array(docs))
        at = np.flatnonzero(n == 0)
        if not len(at):
            continue
        key, node = key.to_numpy(zero_copy_only=False)[at], node.to_numpy()[at]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if key_now is not None and key[0] == key_now:
            new[0] = node[0] != last
        last = node[-1]
        key, node = key[new], node[new]
        if not len(key):
            continue
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.cumsum(head) - 1
        size = np.bincount(group)
        many = size > 1
        extra = []
        if key_now is not None and key[0] == key_now:
            many[0] = True
            if not told:
                extra = [first]
        hit = node[many[group]]
        end = group[-1]
        if key_now is None or key[-1] != key_now:
            first, told = node[np.flatnonzero(head)[-1]], bool(many[end])
        else:
            told = True
        key_now = key[-1]
        hit = np.concatenate([hit, np.array(extra, np.int64)]) if extra else hit
        if len(hit):
            u, c = np.unique(hit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(u), pa.array((-1 - c).astype(np.int32)), pa.nulls(len(u), pa.int64())], schema=PREFIX)


SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])


#: Bits of the filter that tells which documents may be live, 4 MB, and the bits a document must have; for more
#: documents a join tells the same.
FILTER_BITS, BITS_EACH = 1 << 25, 16


def _bits(ids: pa.Array) -> np.ndarray:
    """Two places in the filter for every key; a null key has places too."""
    h = _mixed(ids.fill_null(-(2**62)).to_numpy(zero_copy_only=False).view(np.uint64))
    return np.stack([h & _U(FILTER_BITS - 1), (h >> _U(32)) & _U(FILTER_BITS - 1)])


def _filter_words(batches):
    for batch in batches:
        at = _bits(batch.column(0)).ravel()
        word = (at >> _U(6)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["word", "bits"])


def _wanted_sets(batches, words: np.ndarray):
    """(set, size, shingles) of rows (doc_id, text) whose key the filter lets pass. A row that it lets pass by chance
    costs time and changes nothing: its set shares too little with others to be linked."""
    for batch in batches:
        at = _bits(batch.column(0))
        ok = ((words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).all(axis=0)
        if not ok.any():
            continue
        rows = [(set_id(s), s) for s in shingle_sets(batch.column(1).filter(pa.array(ok))) if len(s)]
        if rows:
            node, sets = zip(*rows)
            off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets)))], schema=SETS)


def _runs(batches):
    """Rows (key, set, size) for every three shingles that follow each other in hash order (and for single ones of
    sets of 8 or fewer). Linked sets differ in at most a quarter of their union, so between the shingles that differ
    some run of three common ones must stand in both: with d different and c >= 3 d common ones, the d + 1 gaps hold
    more than two each on average, unless the union has 8 shingles or fewer."""
    for batch in batches:
        off, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys, own, size = [], [], []
        for r in range(batch.num_rows):
            u = flat[off[r] : off[r + 1]].view(np.uint64)
            if len(u) >= 3:
                keys.append(_mixed(u[:-2] * _PLACE[0] + u[1:-1] * _PLACE[1] + u[2:] * _PLACE[2]))
                own.append(np.full(len(u) - 2, r))
            if len(u) <= 8:
                keys.append(_mixed(u ^ _STEP))
                own.append(np.full(len(u), r))
        own = np.concatenate(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node[own]), pa.array(n[own])], schema=TRIPLE)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chains(batches):
    """From rows sorted by key, size and set: pairs of neighbours of one key whose sizes allow a link. Sizes further
    apart on both sides of a gap allow none, so every possible link lies within a connected chain."""
    held = None
    for batch in batches:
        key, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            key, node, n = (np.concatenate([[h], x]) for h, x in zip(held, (key, node, n)))
        if not len(key):
            continue
        held = key[-1], node[-1], n[-1]
        n = n.astype(np.int64)
        ok = (key[1:] == key[:-1]) & (node[1:] != node[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
        pairs = np.unique(np.stack([np.minimum(node[1:][ok], node[:-1][ok]), np.maximum(node[1:][ok], node[:-1][ok])], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=PAIR)


class Forest:
    """Union-find over the sets of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


class SignatureTree:
    """Levels of nodes over sets in the given order: OR-combined bitmaps of hashed shingles, size ranges, the most
    shingles of a set below that share a bit with another of it (excess), and the component if it is the same all over."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, component: np.ndarray):
        sizes = np.array([len(sets[i]) for i in order], np.int64)
        most = int(np.quantile(sizes, 0.9))
        width = 1 << max(9, int(16 * most - 1).bit_length())
        while width > 512 and width // 8 * len(order) > 64_000_000:
            width //= 2
        bits = np.zeros((len(order), width // 64), np.uint64)
        for r, i in enumerate(order):
            b = (sets[i].view(np.uint64) & _U(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[r], b >> 6, _U(1) << (b & 63).astype(np.uint64))
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, excess, component[order], component[order])]
        while len(self.levels[-1][1]) > FAN:
            b, lo, hi, e, c0, c1 = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, spanning: bool = True) -> np.ndarray:
        """May sets below nodes i and j be linked and, if ``spanning``, not be in one component yet? At most as many
        shingles are common as bits, plus the excess of the side that has less."""
        bits, lo, hi, excess, c0, c1 = self.levels[level]
        ok = (100 * hi[i] >= PERCENT * lo[j]) & (100 * hi[j] >= PERCENT * lo[i])
        if spanning:
            ok &= ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
        i, j = i[ok], j[ok]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(excess[i], excess[j])
        ok[ok] = (100 + PERCENT) * common >= PERCENT * (lo[i] + lo[j])
        return ok

    def pairs(self):
        """Pairs of places in the order that no bound rules out, by traversal of the tree against itself."""
        for i, j in self.pair_arrays():
            yield from zip(i.tolist(), j.tolist())

    def pair_arrays(self, spanning: bool = True):
        """The pairs as arrays; without ``spanning`` those within one component too, each once."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        i, j = np.triu_indices(n)
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONTIER:
                stack.append((level, i[FRONTIER:], j[FRONTIER:]))
                i, j = i[:FRONTIER], j[:FRONTIER]
            keep = self.possible(level, i, j, spanning)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                apart = i < j
                yield i[apart], j[apart]
                continue
            below = len(self.levels[level - 1][1])
            ci = (i[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
            cj = (j[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
            ok = (ci < below) & (cj < below) & (ci <= cj)
            stack.append((level - 1, ci[ok], cj[ok]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets which any links connect, each compared exactly. Sets that agree in a least hash are
    tried first; the signature tree then finds every pair that may still join two components."""
    n = len(sets)
    forest, out = Forest(n), []

    def join(i: int, j: int) -> bool:
        a, b = forest.root(i), forest.root(j)
        if a == b or not linked(sets[i], sets[j]):
            return a == b
        forest.up[max(a, b)] = min(a, b)
        out.append((i, j))
        return True

    if n < 2:
        return out
    flat, off = np.concatenate(sets).view(np.uint64), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    sizes = np.array([len(s) for s in sets])
    for k in range(SHINGLE):
        least = np.minimum.reduceat(_mixed(flat * _PLACE[k]), off)
        order = np.lexsort((sizes, least))
        head = order[0]
        for p, q in zip(order[:-1].tolist(), order[1:].tolist()):
            if least[p] != least[q]:
                head = q
            elif not join(head, q) and not join(p, q):
                head = q
    component = np.array([forest.root(i) for i in range(n)])
    if len(np.unique(component)) > 1:
        order = np.lexsort((sizes, component))
        for p, q in SignatureTree(sets, order, component).pairs():
            join(int(order[p]), int(order[q]))
    return out


def link_counts(sets: list[np.ndarray], spanning: list[tuple[int, int]], copies: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
    """For every set, the copies of all sets that it is linked with, each pair compared exactly; with ``block``, of pairs
    of different blocks only. No link leads out of a component that the spanning links connect."""
    out, forest = np.zeros(len(sets), np.int64), Forest(len(sets))
    for i, j in spanning:
        a, b = forest.root(i), forest.root(j)
        forest.up[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for i in sorted({i for pair in spanning for i in pair}, key=lambda i: (len(sets[i]), i)):
        members.setdefault(forest.root(i), []).append(i)
    for of in members.values():
        at = np.array(of)
        sizes = np.array([len(sets[i]) for i in of])
        off = np.cumsum([0, *sizes])
        names, flat = np.unique(np.concatenate([sets[i] for i in of]), return_inverse=True)
        own = [flat[x:y] for x, y in zip(off[:-1], off[1:])]
        mark = np.zeros(len(names), np.int64)
        tree = SignatureTree([sets[i] for i in of], np.arange(len(of)), np.zeros(len(of), np.int64))
        for i, j in tree.pair_arrays(spanning=False):
            if block is not None:
                apart = block[at[i]] != block[at[j]]
                i, j = i[apart], j[apart]
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            for x, y in zip(*(lambda h: (h, [*h[1:], len(i)]))(np.flatnonzero(np.diff(i, prepend=-1)).tolist())):
                a = i[x]
                mark[own[a]] = 1
                # A slice at a time, so that the shingles laid side by side stay few.
                for z in range(x, y, 1024):
                    b = j[z : min(y, z + 1024)]
                    both = np.add.reduceat(mark[np.concatenate([own[k] for k in b])], np.cumsum([0, *sizes[b[:-1]]]))
                    b = b[100 * both >= PERCENT * (sizes[a] + sizes[b] - both)]
                    out[at[a]] += copies[at[b]].sum()
                    out[at[b]] += copies[at[a]]
                mark[own[a]] = 0
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _linked_groups(batches):
    """Of groups of rows (group, node, n, shingles, copies, block or null) that arrive sorted by group: exact links that
    connect all that links connect, as (set, set, 0), and (set, set itself, copies of the sets that it is linked with)."""
    now, nodes, sets, copies, blocks = None, [], [], [], []

    def told():
        found = spanning_links(sets)
        if found:
            n = link_counts(sets, found, np.array(copies, np.int64), None if blocks[0] is None else np.array(blocks))
            some = np.flatnonzero(n)
            own = np.array(nodes, np.int64)
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[a], own[some]])), pa.array(np.concatenate([own[b], own[some]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), n[some]]))], schema=LINKS)

    for batch in batches:
        group, node, many, block = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
        off, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
        for r, g in enumerate(group):
            if g != now:
                yield from told()
                now, nodes, sets, copies, blocks = g, [], [], [], []
            if not nodes or nodes[-1] != node[r]:
                nodes.append(node[r])
                sets.append(flat[off[r] : off[r + 1]].copy())
                copies.append(many[r])
                blocks.append(block[r])
    yield from told()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, t, node, n, component, n_links): one row for each row of ``docs``: a hash of its text, its set's id and
    size, and the id of a set of its component (its own, if its set has no links).

    Texts with equal sets are one node. A node goes on only if enough of its first shingles (in hash order, by a prefix
    bound) are in another node's; a filter of fixed size tells the second scan which texts to hash again, so texts are
    not shuffled unless the live ones are too many for it. The nodes left are chained by runs of shingles, whose connected
    chains hold every possible link; each chain, or block pair of a long one, is one group in which signature trees find the links,
    compared exactly. n_links counts all other rows that a row is linked with, its set's copies among them; a task
    tells counts, not pairs. Texts without words are linked with nothing and have an empty set. Null keys are rows like others; the
    component of rows that all have null keys is null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = base.mapInArrow(_prefixes, PREFIX_DDL).repartition(int(parts), "key").sortWithinPartitions("key", "node")
    rows = stored(rows.mapInArrow(_shared, PREFIX_DDL), "ngram-rows")
    own = rows.where("n > 0 or n = -1").select(F.col("key").alias("doc_id"), "t", "node", F.greatest("n", F.lit(0)).alias("n"))
    shared = rows.where("n < -1").groupBy("node").agg(F.sum(-1 - F.col("n")).alias("shared"))
    classes = own.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    needed = F.ceil(F.ceil(F.col("n") * PERCENT / 100) / 16)
    live = stored(classes.join(shared, "node").where(F.col("shared") >= needed).select("doc_id"), "ngram-live")
    if live.count() * BITS_EACH <= FILTER_BITS:
        found = live.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(words)
        sets = base.mapInArrow(lambda batches: _wanted_sets(batches, sent.value), "node long, n int, shingles array<bigint>")
    else:
        known = live.distinct().withColumnRenamed("doc_id", "__k")
        asked = base.join(known, base["doc_id"].eqNullSafe(known["__k"]), "left_semi")
        sets = asked.mapInArrow(lambda batches: _wanted_sets(batches, np.full(FILTER_BITS // 64, 2**64 - 1, np.uint64)), "node long, n int, shingles array<bigint>")
    sets = stored(sets, "ngram-sets")
    runs = sets.mapInArrow(_runs, "key long, node long, n int").repartition(int(parts), "key").sortWithinPartitions("key", "n", "node")
    chain = stored(runs.mapInArrow(_chains, "a long, b long").distinct(), "ngram-chains")
    group = connected_components(chain)
    placed = sets.dropDuplicates(["node"]).join(group, "node").join(classes.select("node", "copies"), "node")
    load = stored(placed.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "ngram-load")
    placed = placed.join(load, "component")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j"))))
    placed = placed.select(pairs.alias("p"), "component", "node", "n", "shingles", "copies", block.alias("block"))
    # Of two blocks only pairs of one with the other count; those within a block count in its group with itself.
    placed = placed.select(F.xxhash64("component", "p.i", "p.j").alias("group"), "node", "n", "shingles", "copies", F.when(F.col("p.i") != F.col("p.j"), F.col("block")).alias("block"))
    links = placed.repartition(int(parts), "group").sortWithinPartitions("group", "node").mapInArrow(_linked_groups, "a long, b long, n long")
    links = stored(links, "ngram-links")
    told = links.where("a = b").select(F.col("a").alias("node"), "n").unionByName(classes.select("node", (F.col("copies") - 1).alias("n")))
    degree = told.groupBy("node").agg(F.sum("n").alias("n_links"))
    of = connected_components(links.select("a", "b"))
    own = own.join(of, "node", "left").join(degree, "node", "left")
    return own.select("doc_id", "t", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, n_links): one row for each row of ``docs``, from its ``components``."""
    own = components(docs, text, key)
    named = own.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = own.join(named.withColumnRenamed("component", "c"), (F.col("component") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("node").alias("set_id"), "n_links",
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of ``docs``: of the rows with its smallest key (null keys last) one with the least set
    id, then text hash. Rows are told apart by key and text, so different texts under one key, or under none, are
    documents of their own; rows without words all stay. Rows of one key and text, if they stay, leave one."""
    found = components(docs, text, key).where("n > 0").groupBy("doc_id", "t", "node", "component").agg(F.count(F.lit(1)).alias("rows"))
    found = stored(found, "ngram-found")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node", "t")
    best = found.groupBy("component").agg(F.min(rank).alias("best"), F.sum("rows").alias("rows")).where("rows > 1").select("component", "best")
    many = found.join(stored(best, "ngram-best"), "component")
    many = stored(many.select(F.col("doc_id").alias("__k"), F.col("t").alias("__h"), (rank == F.col("best")).alias("__first"), (F.col("rows") > 1).alias("__again")), "ngram-many")
    hashed = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    left = hashed.join(many, hashed[key].cast("long").eqNullSafe(many["__k"]) & (hashed["__t"] == many["__h"]), "left").where("coalesce(__first, true)")
    once = left.where("not coalesce(__again, false)").select(*docs.columns)
    if many.where("__first and __again").isEmpty():
        return once
    # A grouped minimum, so that not even a hot group of equal rows is gathered.
    row = F.struct(*docs.columns)
    again = left.where("__again").groupBy("__k", "__h").agg(F.min_by(row, F.to_json(row)).alias("r"))
    return once.unionByName(again.select("r.*"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, coalesce(k.n, 0)::BIGINT AS n_links FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a) k USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
