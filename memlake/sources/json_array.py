"""Elements of huge JSON arrays read by many tasks: blocks tell how they change the reader's state, and where elements begin."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.plans.tables import stored
from memlake.sources.tailing import Files

#: Bytes of a block, and tasks at most.
BLOCK, TASKS = 16 << 20, 10_000
#: What a reader can be in: outside strings, in one, or in one just after a backslash that escapes what comes next.
OUT, IN, ESCAPED = 0, 1, 2
OPENS, CLOSES = np.frombuffer(b"[{", np.uint8), np.frombuffer(b"]}", np.uint8)


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, signs, state): brackets, braces and commas outside strings, and the state after ``data``."""
    signs = np.frombuffer(data, np.uint8)
    if not len(signs):
        return np.zeros(0, np.int64), signs, state
    if state == ESCAPED:
        signs = signs.copy()
        signs[0] = ord("x")
    place = np.arange(len(signs))
    plain = np.maximum.accumulate(np.where(signs != ord("\\"), place, -1))
    quotes = np.flatnonzero(signs == ord('"'))
    # A quote is escaped by an odd run of backslashes before it.
    run = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)
    quotes = quotes[run % 2 == 0]
    found = np.flatnonzero(np.isin(signs, np.frombuffer(b"[]{},", np.uint8)))
    outside = (np.searchsorted(quotes, found) + (state != OUT)) % 2 == 0
    found = found[outside]
    end = (len(quotes) + (state != OUT)) % 2
    if end == IN and (len(signs) - 1 - plain[-1]) % 2:
        end = ESCAPED
    return found, signs[found], end


def _deeper(signs: np.ndarray) -> np.ndarray:
    return np.isin(signs, OPENS).astype(np.int64) - np.isin(signs, CLOSES)


def change(data: bytes) -> list[tuple[int, int]]:
    """(state, change of depth) after a block, for each state before it."""
    return [(end, int(_deeper(signs).sum())) for _, signs, end in (structure(data, s) for s in (OUT, IN, ESCAPED))]


def borders(data: bytes, state: int, depth: int) -> tuple[np.ndarray, int, int]:
    """(places, state, depth): where elements of the outermost array are parted, at its brackets and at its own commas."""
    places, signs, end = structure(data, state)
    step = _deeper(signs)
    after = depth + np.cumsum(step)
    own = ((signs == ord("[")) & (after == 1)) | ((signs == ord("]")) & (after == 0)) | ((signs == ord(",")) & (after == 1))
    return places[own], end, depth + int(step.sum())


def elements(read, size: int, low: int, high: int, state: int, depth: int, block: int = BLOCK):
    """(start, bytes) of the elements whose border before them lies in [low, high); ``read`` gives bytes of a range. Reads on
    past ``high`` until the last of them ends."""
    open_at, held, at = None, b"", low
    while at < size and (at < high or open_at is not None):
        data = read(at, min(at + block, size if at >= high else high))
        cuts, state, depth = borders(data, state, depth)
        for cut in cuts:
            if open_at is not None:
                whole = held + data[max(0, open_at - at) : cut]
                if whole.strip():
                    yield open_at, whole
                held, open_at = b"", None
            if at + cut < high and data[cut : cut + 1] != b"]":
                open_at = at + int(cut) + 1
            elif at + cut >= high:
                return
        if open_at is not None:
            held += data[max(0, open_at - at) :]
        at += len(data)


def read_elements(spark: SparkSession, folder: str, pattern: str = "*.json", block: int = BLOCK) -> DataFrame:
    """(path, start, element): the elements of the JSON arrays in the files below a folder, as text, with the byte they
    begin at. Files are read in blocks: a first pass tells how each block changes the state of a reader for every
    state before it, which is put together file by file, and a second one reads the elements that begin in each block.
    So one huge file is many tasks; a task holds one block and one element. Files of any file system that Arrow opens."""
    files = Files(folder, pattern)
    known = sorted(files.sizes().items())
    sizes = spark.createDataFrame(known, "path string, size long")
    # Rows that name blocks are small, so adaptive execution would put them together; a stated number stays.
    tasks = max(1, min(sum(-(-size // block) for _, size in known), TASKS))
    blocks = sizes.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {block}L)")).alias("low")).where("size > 0")
    blocks = stored(blocks.withColumn("high", F.least(F.col("low") + block, F.col("size"))), "array-blocks")

    def opened(path: str):
        def read(low: int, high: int) -> bytes:
            with files.fs.open_input_file(path) as f:
                f.seek(low)
                return f.read(high - low)

        return read

    def scan(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                told = change(opened(r["path"])(r["low"], r["high"]))
                yield pd.DataFrame([(r["path"], r["size"], r["low"], r["high"], *[x for pair in told for x in pair])], columns=["path", "size", "low", "high", "s0", "d0", "s1", "d1", "s2", "d2"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        state, depth, out = OUT, 0, []
        for r in frame.sort_values("low").to_dict("records"):
            out.append((r["path"], r["size"], r["low"], r["high"], state, depth))
            state, depth = r[f"s{state}"], depth + r[f"d{state}"]
        return pd.DataFrame(out, columns=["path", "size", "low", "high", "state", "depth"])

    told = blocks.repartition(tasks, "path", "low").mapInPandas(scan, "path string, size long, low long, high long, s0 int, d0 long, s1 int, d1 long, s2 int, d2 long")
    settled = stored(told.groupBy("path").applyInPandas(settle, "path string, size long, low long, high long, state int, depth long"), "array-states")
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("element", pa.string())])

    def parts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for start, data in elements(opened(r["path"]), r["size"], r["low"], r["high"], r["state"], r["depth"], block):
                    rows.append({"path": r["path"], "start": start, "element": data.decode("utf-8", "replace").strip()})
                    size += len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return settled.repartition(tasks, "path", "low").mapInArrow(parts, "path string, start long, element string")
