"""Byte-level BPE by a lazily determinised finite-state transducer; decoding by an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from memlake.llm.common import small_batches

#: Entries kept of each memo; what a full one drops is worked out again, which costs time and changes nothing.
MEMO = 300_000
STATES = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


class Transducer:
    """Maps the bytes of one piece to its BPE tokens, byte by byte.

    A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and every two
    neighbours encode to themselves: that turns the merges into a non-deterministic transducer whose states are
    (last whole token, trie node of the token begun). Its subsets are determinised on first use. Each live hypothesis
    has a register for the tokens it would emit; a transition says which register each new hypothesis continues and
    which token it closes, and once one hypothesis is left its register is emitted. For each place there is one
    encoding of the bytes before it, so a state has no more hypotheses than the longest token has bytes: the lookahead
    is bounded by that length.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(self.token):
                    self.child.append({})
                    self.token.append(-1)
            self.token[node] = rank
        self.joins: dict[int, bool] = {}
        self.grown: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: list[dict[int, tuple[int, tuple]]] = []
        self.ends: dict[int, tuple[int, int]] = {}
        self.start = self.state(((-1, 0),))

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return found

    def edges(self, token: int) -> tuple[bool, list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """How the merges build one token from its bytes: whether they do, and how the part at its left edge and the one
        at its right edge grow, as (rank of the merge, part), from the single byte on."""
        found = self.grown.get(token)
        if found is None:
            word, ranks = self.bytes_of[token], self.ranks
            parts = [word[i : i + 1] for i in range(len(word))]
            left, right = [(-1, parts[0])], [(-1, parts[-1])]
            while len(parts) > 1:
                rank, at = min((ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == self.size:
                    break
                whole = parts[at] + parts[at + 1]
                if at == 0:
                    left.append((rank, whole))
                if at == len(parts) - 2:
                    right.append((rank, whole))
                parts[at : at + 2] = [whole]
            found = self.grown[token] = (len(parts) == 1, left, right)
        return found

    def joined(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (-1: nothing)? Both must encode to themselves, and no merge may cross the border
        between them while their edge parts grow; of equal merges the one further left comes first."""
        key = (left + 1) * self.size + right
        found = self.joins.get(key)
        if found is None:
            if len(self.joins) > MEMO:
                self.joins.clear()
            found, b, _ = self.edges(right)
            if found and left >= 0:
                a, i, j, ranks, size = self.edges(left)[2], 0, 0, self.ranks, self.size
                while True:
                    next_a = a[i + 1][0] if i + 1 < len(a) else size
                    next_b = b[j + 1][0] if j + 1 < len(b) else size
                    across = ranks.get(a[i][1] + b[j][1], size)
                    if across < next_a and across <= next_b and across < size:
                        found = False
                        break
                    if next_a == next_b == size:
                        break
                    if next_a <= next_b:
                        i += 1
                    else:
                        j += 1
            self.joins[key] = found
        return found

    def advance(self, at: int, b: int) -> tuple[int, tuple]:
        """The transition from a state: the next one, and (register, closed token or -1) of each of its hypotheses."""
        child, token, joins, size = self.child, self.token, self.joins, self.size
        out, moves = [], []
        for i, (last, node) in enumerate(self.states[at]):
            n = child[node].get(b)
            if n is not None:
                out.append((last, n))
                moves.append((i, -1))
            t = token[node]
            if t >= 0:
                ok = joins.get((last + 1) * size + t)
                if ok or (ok is None and self.joined(last, t)):
                    out.append((t, child[0][b]))
                    moves.append((i, t))
        found = self.step[at][b] = (self.state(tuple(out)), tuple(moves))
        return found

    def finish(self, at: int) -> tuple[int, int]:
        """Of the hypotheses at the end of a piece, the one whose last token is whole and may stand there, and that token."""
        for i, (last, node) in enumerate(self.states[at]):
            t = self.token[node]
            if t >= 0 and self.joined(last, t):
                found = self.ends[at] = (i, t)
                return found
        raise ValueError("the ranks have no token for some byte")

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if len(self.states) > STATES:
            self.reset()
        at, step, out, regs = self.start, self.step, [], [()]
        for b in piece:
            at, moves = step[at].get(b) or self.advance(at, b)
            if len(moves) == 1:
                (i, t), = moves
                out += _told(regs[i])
                if t >= 0:
                    out.append(t)
                regs = [()]
            else:
                regs = [(regs[i], t) if t >= 0 else regs[i] for i, t in moves]
        i, t = self.ends.get(at) or self.finish(at)
        out += _told(regs[i])
        out.append(t)
        return out


def _told(register: tuple) -> list[int]:
    """The tokens of a register, which links each to the register before it."""
    out = []
    while register:
        register, t = register
        out.append(t)
    return out[::-1]


class StreamDecoder:
    """Tokens to text as they come: bytes of a sign cut between tokens wait for the rest. The machine's state is
    (bytes still due, least and most that the next may be); wrong bytes become U+FFFD, as in UTF-8 decoding."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.waiting = b""
        self.due, self.low, self.high = 0, 0x80, 0xBF

    def push(self, ids) -> str:
        """Text that is complete after ``ids``."""
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._open(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def _open(self, data: bytes) -> int:
        """How many bytes at the end begin a sign that is not complete."""
        for back in range(1, min(4, len(data)) + 1):
            self._restart()
            for b in data[len(data) - back :]:
                if not self._take(b):
                    break
            else:
                if self.due:
                    return back
            if data[-back] & 0xC0 != 0x80:
                break
        return 0

    def _restart(self) -> None:
        self.due, self.low, self.high = 0, 0x80, 0xBF

    def _take(self, b: int) -> bool:
        if not self.due:
            if b < 0x80:
                return True
            if 0xC2 <= b <= 0xDF:
                self.due = 1
            elif 0xE0 <= b <= 0xEF:
                self.due, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.due, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                return False
            return True
        if not self.low <= b <= self.high:
            return False
        self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
        return True

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to little-endian 32-bit ids and back: pieces by the pattern, each through the transducer once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.machine = Transducer(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        get, out = self.memo.get, []
        for piece in self.find(text):
            ids = get(piece)
            if ids is None:
                ids = self.learn(piece)
                get = self.memo.get
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes, block: int = 8192) -> str:
        ids = array("I")
        ids.frombytes(packed)
        decoder = StreamDecoder(self.machine.bytes_of)
        out = [decoder.push(ids[i : i + block]) for i in range(0, len(ids), block)]
        return "".join(out) + decoder.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, with what it has learnt."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _codecs[path, pattern]


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", digest: bool = False, ids: bool | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of a column of that name, and with ``digest`` the columns n_tokens,
    ids_sha256 and decoded_sha256 of a round trip (then ``ids`` only on demand). Null text counts as empty and has no tokens; special tokens are
    ordinary text; every row gets its own result. ``path`` names a file of ranks that every executor has."""
    small_batches(docs.sparkSession)
    ids = not digest if ids is None else ids
    named = ("n_tokens", "ids_sha256", "decoded_sha256") * digest + ("ids",) * ids
    docs = docs.drop(*[c for c in docs.columns if c in named])
    added = [pa.int64(), pa.string(), pa.string()] * digest + [pa.list_(pa.int32())] * ids
    at = docs.columns.index(text)

    def run(batches):
        own = codec(*_vocabulary(path, pattern))
        for batch in batches:
            columns = [[] for _ in named]
            for t in batch.column(at):
                packed = own.encode(t.as_py() or "")
                row = ()
                if digest:
                    row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed).encode()).hexdigest())
                if ids:
                    row += (array("i", packed),)
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, added)]], names=[*batch.schema.names, *named])

    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, kinds.get(n, T.StringType())) for n in named]])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``text`` decoded from its ids; null ids give an empty text."""
    small_batches(tokens.sparkSession)
    tokens = tokens.drop(*[c for c in tokens.columns if c == "text"])
    at = tokens.columns.index(ids)

    def run(batches):
        own = codec(*_vocabulary(path, pattern))
        for batch in batches:
            texts = [own.decode(array("I", v.as_py() or []).tobytes()) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())]))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
