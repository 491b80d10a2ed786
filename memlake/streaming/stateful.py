"""Mutations as a stateful stream: revisions, stored results of mutation ids and their expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlake.operators.mutate import STATE, Entry

#: How long the result of a mutation id is kept, in hours.
KEPT_HOURS = 72
HELD = "there boolean, revision int, archived boolean, view string, confidence string, state string, context_type string, insights array<string>"
OUT = "entry_id {key}, mutation_id string, status string, revision int, replayed boolean, archived boolean, view string, confidence string, state string, context_type string, insights array<string>"


def _plain(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value


class Mutations(StatefulProcessor):
    """One entry's mutations: its state, and what each mutation id gave, until a timer lets it go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", HELD)
        self.results = handle.getMapState("results", "mutation_id string", "status string, revision int, ts long")

    def _load(self) -> Entry:
        found = self.entry.get() if self.entry.exists() else None
        return Entry(found[0], dict(zip(STATE, [_plain(v) if c != "insights" else list(v) for c, v in zip(STATE, found[1:])]))) if found else Entry(False, None)

    def _save(self, entry: Entry) -> None:
        s = entry.state
        self.entry.update((entry.there, *[s[c] for c in STATE]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        s = {c: _plain(row[c]) if c != "insights" else list(row[c]) if row[c] is not None else [] for c in STATE}
        self._save(Entry(True, s | {"revision": int(s["revision"]), "archived": bool(s["archived"])}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        entry, out = self._load(), []
        blank = dict.fromkeys(("archived", "view", "confidence", "state", "context_type", "insights"))
        for m in pd.concat(parts).sort_values(["ts", "mutation_id"], kind="stable").to_dict("records"):
            m = {k: _plain(v) for k, v in m.items()}
            mutation = (m["mutation_id"],)
            stored = self.results.getValue(mutation) if self.results.containsKey(mutation) else None
            if stored is None:
                status = entry.take(m)
                stored = (status, entry.state["revision"], int(m["ts"].timestamp() * 1000))
                self.results.updateValue(mutation, stored)
                self.handle.registerTimer(stored[2])  # the watermark gets there when results of its time go
                replayed = False
            else:
                replayed = True
            out.append({"entry_id": key[0], "mutation_id": m["mutation_id"], "status": stored[0], "revision": stored[1], "replayed": replayed, **blank})
        self._save(entry)
        if entry.there:
            out.append({"entry_id": key[0], "mutation_id": None, "status": None, "replayed": None, **entry.state})
        yield pd.DataFrame(out, columns=["entry_id", "mutation_id", "status", "revision", "replayed", *blank])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        for mutation in [k for k, v in self.results.iterator() if v[2] <= until]:
            self.results.removeKey(mutation)
        return iter(())

    def close(self) -> None:
        pass


def mutations(stream: DataFrame, entries: DataFrame | None = None, hours: int = KEPT_HOURS) -> DataFrame:
    """Rows of a stream of mutations, columns as in ``mutate.fold``: a result for each, and after each micro-batch the
    state of every entry that it touched (mutation_id and status null).

    Mutations are taken in the order of their batches, within one by time and id, against the entry's own state, which
    begins with ``entries``. A mutation id that comes again gets its stored result, told as replayed, and changes nothing,
    until the stream is ``hours`` past it; ids belong to one entry. The watermark is that far behind, so a mutation of
    an older time is too late and goes. Start it in append mode with a RocksDB state store."""
    key = stream.schema["entry_id"].dataType.simpleString()
    names = ("mutation_id", "ts", "kind", "entry_id", "expected_revision", "view", "confidence", "state", "context_type", "insight")
    by = stream.select(*names).withWatermark("ts", f"{hours} hours").groupBy("entry_id")
    first = entries.select("entry_id", *STATE).groupBy("entry_id") if entries is not None else None
    return by.transformWithStateInPandas(Mutations(), OUT.format(key=key), "append", "eventTime", first)


def rocksdb(spark) -> None:
    """Set what the stateful operator needs: the state store that keeps several states of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
