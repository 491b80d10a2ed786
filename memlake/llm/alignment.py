"""Cross-tokenizer alignment in Arrow: ends of tokens joined on document-end keys, counts of id pairs merged by Spark."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.common import small_batches, stored

#: Segments and tokens that a worker remembers, and segments that go through the Arrow pipeline at a time.
KEPT, KEPT_TOKENS, CHUNK = 1_000_000, 6_000_000, 150_000
#: Id pairs whose counts are sent to all tasks (16 bytes each); all others meet their counts in an equi-join.
FREQUENT = 524_288
#: Pairs that a worker counts before it hands on what it has.
COUNTED = 1_000_000
#: Where a text can be cut: between a sign and the single space after it.
CUT = re.compile(r"(?<=\S)(?= )")


def byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers in a worker, with the tokens of segments seen before.

    No token of either side crosses the place between a sign and a space after it (checked when the files are read: the
    first cuts words there before it merges, and the second has no piece with a space after another sign), so both
    encode segments as they do whole texts, and most segments of a corpus come again."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        told = json.loads(self.a.to_str())
        before = told.get("pre_tokenizer") or {}
        signs, special = byte_signs(), {t["content"] for t in told.get("added_tokens", ())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(map(signs.__getitem__, token))
        n = self.b.get_piece_size()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        self.cut = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
            and not any(re.search("[^▁]▁", piece(i)) for i in range(n))
        )
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (pa.array([len(x) for x in of], pa.int64()) for of in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.unsound, self.odd = bytearray(), bytearray()
        self.ids_a, self.ids_b, self.off_a, self.off_b = array("i"), array("i"), array("i", [0]), array("i", [0])

    def full(self, kept: int) -> bool:
        return len(self.number) > kept or len(self.ids_a) > KEPT_TOKENS or len(self.ids_b) > KEPT_TOKENS

    def learn(self, new: list[str]) -> None:
        """Encode segments that were not seen yet; each is named by what follows its space."""
        many = [[e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)], [ids or [self.space] for ids in self.b.encode(new, num_threads=1)]]
        whole = [b" " + p.encode() for p in new]
        sides = [[b"".join(map(of.__getitem__, ids)) for ids in side] for side, of in zip(many, (self.bytes_a, self.bytes_b))]
        for p, a, b, fits in zip(new, *many, map(lambda w, a, b: w == a == b, whole, *sides)):
            self.number[p] = len(self.odd)
            self.unsound.append(not fits)
            self.odd.append(not p or p[0].isspace())
            if fits:
                self.ids_a.extend(a)
                self.ids_b.extend(b)
            self.off_a.append(len(self.ids_a))
            self.off_b.append(len(self.ids_b))

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        look = lambda parts: np.fromiter(map(self.number.get, parts, repeat(-1)), np.int32, len(parts))
        found = [look(parts) for parts in texts]
        lacks = [n for n, at in enumerate(found) if (at < 0).any()]
        if lacks:
            self.learn(list(dict.fromkeys(texts[n][i] for n in lacks for i in np.flatnonzero(found[n] < 0))))
            for n in lacks:
                found[n] = look(texts[n])
        return found

    def segments(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Numbers of each text's segments; None where a text has no tokens."""
        some = [n for n, text in enumerate(texts) if text]
        found = self._numbers([texts[n].split(" ") if self.cut else [texts[n]] for n in some])
        if self.cut:
            # Runs of white space are not cut within.
            odd = np.frombuffer(bytes(self.odd), bool)
            again = [k for k, at in enumerate(found) if odd[at].any()]
            for k, at in zip(again, self._numbers([[p[1:] for p in CUT.split(" " + texts[some[k]])] for k in again])):
                found[k] = at
        unsound = np.frombuffer(bytes(self.unsound), bool)
        out = [None] * len(texts)
        for n, at in zip(some, found):
            out[n] = None if unsound[at].any() else at
        return out

    def lists(self) -> list[pa.ListArray]:
        """The tokens of all segments, on both sides."""
        plain = lambda x: pa.array(np.frombuffer(x.tobytes(), np.int32))
        return [pa.ListArray.from_arrays(plain(self.off_a), plain(self.ids_a)), pa.ListArray.from_arrays(plain(self.off_b), plain(self.ids_b))]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(path_a: str | None, path_b: str | None) -> Tokenizers:
    import public_tokenizers

    key = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    if key not in _loaded:
        pa.set_cpu_count(1)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        _loaded[key] = Tokenizers(*key)
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _loaded[key]


def per_document(lists: pa.ListArray, pick: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """The lists of the segments in ``pick``, put together to one list for each document; documents begin at ``starts``."""
    taken = lists.take(pa.array(pick))
    off = taken.offsets.to_numpy()[np.append(starts, len(pick))]
    return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), taken.flatten())


def ends(tokens: pa.ListArray, sizes: pa.Array, side: str) -> pa.Table:
    """(key, nth): each token's document-end key and its number. Lists are flattened with their parents' indices, sizes
    summed up, and each document's sum before it taken off again; the key is the document above 32 bits of the end."""
    ids, parent = tokens.flatten(), pc.list_parent_indices(tokens).cast(pa.int64())
    total = pc.cumulative_sum(sizes.take(ids))
    first = tokens.offsets.to_numpy()[:-1]
    before = np.concatenate([[0], total.to_numpy()])[first]
    end = pc.subtract(total, pa.array(before).take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, 32), end), side: pa.array(np.arange(len(ids)))})


class Aligned:
    """Alignment of documents' tokens: ``a`` and ``b`` are lists of ids, of equal bytes in each document."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, sizes_a: pa.Array, sizes_b: pa.Array):
        self.a, self.b = a, b
        met = ends(a, sizes_a, "a").join(ends(b, sizes_b, "b"), "key", join_type="full outer", use_threads=False).combine_chunks()
        met = met.take(pc.sort_indices(met, [("key", "ascending")]))
        # Between two ends lies a link: the tokens that end there or next after it.
        self.shared = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"])).to_numpy()
        self.at_a, self.at_b = (pc.is_valid(met[s]).to_numpy() for s in "ab")
        self.doc = pc.shift_right(met["key"], 32).to_numpy()
        self.link_a, self.link_b = (pc.fill_null_backward(met[s].combine_chunks()).to_numpy(zero_copy_only=False) for s in "ab")

    def counts(self) -> dict[str, np.ndarray]:
        n = len(self.a)
        return {
            "n_a": np.diff(self.a.offsets.to_numpy()).astype(np.int64), "n_b": np.diff(self.b.offsets.to_numpy()).astype(np.int64),
            "n_groups": np.bincount(self.doc[self.shared], minlength=n).astype(np.int64), "n_links": np.bincount(self.doc, minlength=n).astype(np.int64),
        }

    def pairs(self) -> pa.Table:
        """(doc, a, b, n): how often a document's links hold a pair of ids, in order of documents."""
        ids_a, ids_b = self.a.flatten(), self.b.flatten()
        links = pa.table({"doc": self.doc, "a": ids_a.take(pa.array(self.link_a)), "b": ids_b.take(pa.array(self.link_b))})
        n = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        return n.rename_columns(["doc", "a", "b", "n"] if n.column_names[0] == "doc" else ["n", "doc", "a", "b"]).sort_by("doc").combine_chunks()

    def told(self, words: pa.Array, size_a: int, size_b: int, goes_on: np.ndarray) -> list[memoryview]:
        """Each document's groups as `a1,a2|b1;a3|b2`: tokens of both sides in the order of their groups, as words with
        what stands after them, so that a document is one slice of the bytes. ``goes_on``: more of it follows."""
        group = np.cumsum(self.shared) - self.shared
        of_a, of_b = group[self.at_a], group[self.at_b]
        groups = int(self.shared.sum())
        in_a, in_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        place_a = np.arange(len(of_a)) + (np.cumsum(in_b) - in_b)[of_a]
        place_b = np.arange(len(of_b)) + np.cumsum(in_a)[of_b]
        last_a, last_b = np.append(np.diff(of_a) != 0, True), np.append(np.diff(of_b) != 0, True)
        after_b = last_b.astype(np.int64)
        off_a, off_b = self.a.offsets.to_numpy(), self.b.offsets.to_numpy()
        some = np.diff(off_b) > 0
        after_b[off_b[1:][some & ~goes_on] - 1] = 2
        code = np.empty(len(of_a) + len(of_b), np.int64)
        code[place_a] = self.a.flatten().to_numpy() + size_a * last_a
        code[place_b] = self.b.flatten().to_numpy() + 2 * size_a + size_b * after_b
        text = words.take(pa.array(code))
        cuts = np.frombuffer(text.buffers()[1], np.int64)[: len(code) + 1][off_a.astype(np.int64) + off_b]
        data = memoryview(text.buffers()[2]) if len(code) else memoryview(b"")
        return [data[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def words(size_a: int, size_b: int) -> pa.Array:
    """Every id as a word with each of its endings: two of the first side, three of the second."""
    return pa.array([f"{i}{end}" for size, ends_ in ((size_a, ",|"), (size_b, (",", ";", ""))) for end in ends_ for i in range(size)], pa.large_string())


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in NUMBERS], ("groups_sha256", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "n")]])
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK, kept: int = KEPT) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, n): documents with their numbers, the digest of
    their groups, and lists of the id pairs that their links hold and how often. A very long document comes in several
    rows of one ``row``, of which the last has the digest. Stored, so that rows keep their numbers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        own = _tokenizers(path_a, path_b)
        size_a, size_b = len(own.bytes_a), len(own.bytes_b)
        vocabulary = words(size_a, size_b)
        digest = {}

        def flush(held):
            at = np.concatenate([h[2] for h in held])
            starts = np.cumsum([0, *[len(h[2]) for h in held[:-1]]])
            found = Aligned(*[per_document(x, at, starts) for x in own.lists()], own.size_a, own.size_b)
            goes_on = np.array([h[3] for h in held])
            hashes = []
            for (row, *_, more), text in zip(held, found.told(vocabulary, size_a, size_b, goes_on)):
                sha = digest.pop(row, None) or hashlib.sha256()
                sha.update(text)
                if more:
                    digest[row] = sha
                hashes.append(None if more else sha.hexdigest())
            pairs = found.pairs()
            off = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(held) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pairs[c].combine_chunks().cast(pa.int32())) for c in ("a", "b", "n")]
            numbers = found.counts()
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.int64()), *[pa.array(numbers[c]) for c in NUMBERS], pa.array(hashes, pa.string()), *lists], schema=SCHEMA)

        held, size = [], 0
        for batch in batches:
            blank = []
            if own.full(kept):
                if held:
                    yield from flush(held)
                held, size = [], 0
                own.forget()
            row_ids, doc_ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for row, doc_id, at in zip(row_ids, doc_ids, own.segments(texts)):
                if at is None:
                    blank.append((row, doc_id))
                    continue
                for i in range(0, len(at), chunk):
                    held.append((row, doc_id, at[i : i + chunk], i + chunk < len(at)))
                    size += len(held[-1][2])
                    if size >= chunk:
                        yield from flush(held)
                        held, size = [], 0
            if blank:
                none, empty = pa.array([0] * len(blank)), pa.array([[]] * len(blank), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blank]), pa.array([x[1] for x in blank], pa.int64()), *[none] * 4, pa.array([""] * len(blank)), *[empty] * 3], schema=SCHEMA)
        if held:
            yield from flush(held)

    return stored(rows.mapInArrow(run, ALIGNED), "alignment")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each id pair. Workers count what they read and Spark adds it up."""

    def run(batches):
        def summed(parts):
            return pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"])

        parts, rows = [], 0
        for batch in batches:
            parts.append(pa.table({"a": batch.column(0).flatten(), "b": batch.column(1).flatten(), "n": batch.column(2).flatten().cast(pa.int64())}))
            rows += parts[-1].num_rows
            if rows > COUNTED:
                parts = [summed(parts)]
                rows = parts[0].num_rows
                if rows > COUNTED // 2:
                    yield from parts[0].combine_chunks().to_batches()
                    parts, rows = [], 0
        if rows:
            yield from summed(parts).combine_chunks().to_batches()

    partial = found.select("a", "b", "n").mapInArrow(run, "a int, b int, n long")
    return stored(partial.groupBy("a", "b").agg(F.sum("n").alias("n")), "alignment-counts")


def _step(n):
    """Counts in eighths of a power of two, so that there are few steps whatever the corpus."""
    return F.floor(F.log2(n) * 8).cast("int")


def with_counts(found: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, doc_id, ..., n_best, count_sum): documents with the sum over their links of the pair's count, and how many
    links have a count that is the highest of their second id.

    Counts of the most frequent pairs, ``frequent`` at most, are sent to all tasks, and so is the highest count of each
    second id, of which there are no more than that vocabulary has. What links are left have rare pairs, each held by
    few links, and meet their counts in an equi-join that no key can make uneven."""
    spark = found.sparkSession
    steps = {r["step"]: r["pairs"] for r in counts.groupBy(_step(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least, held = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        held += steps[step]
        if held > frequent:
            break
        least = step
    top = counts.where(_step(F.col("n")) >= least).toArrow()
    best = counts.groupBy("b").agg(F.max("n").alias("best"))
    highest = best.toArrow()
    size = (pc.max(highest["b"]).as_py() or 0) + 1 if highest.num_rows else 1
    by_b = np.zeros(size, np.int64)
    by_b[highest["b"].to_numpy()] = highest["best"].to_numpy()
    key = (top["a"].to_numpy().astype(np.int64) << 32) | top["b"].to_numpy()
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], top["n"].to_numpy()[order], by_b))
    names = ("row", "doc_id", *NUMBERS, "groups_sha256")
    schema = pa.schema([*[SCHEMA.field(c) for c in names], ("n_best", pa.int64()), ("count_sum", pa.int64()), *[SCHEMA.field(c) for c in ("a", "b", "n")]])

    def run(batches):
        keys, counted, by_b = sent.value
        for batch in batches:
            a, b, n = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n"))
            doc = pc.list_parent_indices(a).to_numpy()
            a, b, n = (x.flatten().to_numpy() for x in (a, b, n))
            pair = (a.astype(np.int64) << 32) | b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            there = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            count = np.where(there, counted[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
            rows = batch.num_rows
            total, most = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(total, doc, count * n)
            np.add.at(most, doc, np.where(there & (count == by_b[b]), n, 0))
            left = ~there
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[left], minlength=rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x[left])) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(most), pa.array(total), *lists], schema=schema)

    partial = stored(found.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in (*names, "n_best", "count_sum")) + ", a array<int>, b array<int>, n array<int>"), "alignment-sums")
    rare = partial.where("size(a) > 0").select("row", F.inline(F.arrays_zip("a", "b", "n"))).withColumnRenamed("n", "links")
    rest = counts.where(_step(F.col("n")) < least).join(F.broadcast(best), "b")
    met = rare.join(rest, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    more = met.select("row", F.lit(None).cast("long").alias("doc_id"), *[zero.alias(c) for c in NUMBERS], F.lit(None).cast("string").alias("groups_sha256"), "n_best", "count_sum")
    whole = partial.drop("a", "b", "n").unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in (*NUMBERS, "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"))
    return whole


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs`` (doc_id,
    text, others play no part).

    Both tokenizers encode a text after a space. Where tokens of both end at one byte, a group ends; tokens whose bytes
    overlap are linked; an id pair counts as many links as hold it in all of ``docs``. A text that is null or empty, or
    that the tokens do not give back byte by byte, has no tokens: zeros and an empty digest. Repeated rows each count
    and each get their own; null ids stay; an empty table gives an empty result. Paths name files that every executor
    has."""
    found = aligned(docs, path_a, path_b)
    return with_counts(found, pair_counts(found), frequent).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
