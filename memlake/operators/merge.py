"""Merging extracted entries into the store: candidates by shared keys, then update, evolve or contest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.functions.scoring import cosine, filled, tokens
from memlake.plans.pieces import meetings
from memlake.plans.tables import stored


#: Pairs of entries that one key may bring together in a join; keys beyond it are compared in blocks.
PAIRS = 1_000_000
#: Stored entries that a task holds of such a key, and new ones that it compares with them at a time.
HELD, ASKED = 4096, 256


def _keys(df: DataFrame) -> DataFrame:
    """(id, key): pairs of words of each label, and its repositories."""
    words = F.array_sort(tokens(F.col("label")))
    pairs = F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.concat_ws(" ", F.lit("w"), a, b))))
    repos = F.transform(F.filter(F.coalesce("repos", F.array().cast("array<string>")), lambda r: r.isNotNull()), lambda r: F.concat(F.lit("r "), F.lower(r)))
    return df.select(F.col("entry_id").alias("id"), F.explode(F.array_distinct(F.concat(pairs, repos))).alias("key"))


def _incidence(lists: list[list[str]], names: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(lists), len(names)), np.float32)
    for row, items in enumerate(lists):
        out[row, [names[i] for i in items if i in names]] = 1
    return out


def _shared(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """How many items each list of the left has in common with each of the right."""
    names = {w: n for n, w in enumerate(dict.fromkeys(w for items in left for w in items))}
    return _incidence(left, names) @ _incidence(right, names).T


def _unit(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one width made one long, and which of them have that width and a length."""
    out, known = np.zeros((len(vectors), width)), np.zeros(len(vectors), bool)
    for row, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            size = float(np.sqrt(np.dot(v, v)))
            known[row] = size > 0
            out[row] = np.array(v) / size if size > 0 else 0.0
    return out, known


def _blocks(near: float, schema: pa.Schema):
    """Over rows sorted by key, split and side, stored entries first: of each new one the best match in the split."""

    def best(asked: list[dict], held: list[dict]):
        rows = []
        for width in {len(a["v"]) for a in asked if a["v"] is not None}:
            mine = [a for a in asked if a["v"] is not None and len(a["v"]) == width]
            (a, ok_a), (b, ok_b) = _unit([x["v"] for x in mine], width), _unit([x["v"] for x in held], width)
            cos = np.where(ok_a[:, None] & ok_b[None, :], a @ b.T, 0.0)
            n = (_shared([x["words"] for x in mine], [x["words"] for x in held]) >= 2).astype(int) + (_shared([x["repos"] for x in mine], [x["repos"] for x in held]) >= 1) + (cos > near)
            fit = np.where((n >= 2) & (cos > 0), cos, -1.0)
            at = fit.argmax(1)
            rows += [{"new_id": x["id"], "old_id": held[j]["id"], "similarity": float(fit[i, j]), "signals": int(n[i, j])} for i, (x, j) in enumerate(zip(mine, at)) if fit[i, j] > 0]
        return rows

    def run(batches):
        now, held, asked = None, [], []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["key"], row["split"]) != now:
                    out += best(asked, held) if asked and held else []
                    now, held, asked = (row["key"], row["split"]), [], []
                if row["side"] == 0:
                    held.append(row)
                    continue
                asked.append(row)
                if len(asked) == ASKED:
                    out += best(asked, held) if held else []
                    asked = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = best(asked, held) if asked and held else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def matches(new: DataFrame, old: DataFrame, near: float = 0.85, pairs: int = PAIRS, rows: int = HELD) -> DataFrame:
    """(new_id, old_id, similarity, signals): for each new entry (entry_id, label, repos, embedding) the stored entry with
    at least two of three signals: cosine above ``near``, two words of the label in common, a repository in common; the
    nearest of them, with a similarity above 0.

    Two signals always include words or a repository, so candidates come from equi-joins on pairs of words and on
    repositories, and vectors are compared only for those. A key that would bring more than ``pairs`` pairs together, as
    a repository of all entries does, makes none: its stored entries are dealt into splits of about ``rows``, its new
    ones go to each, and one best match for each of them leaves a split, found by matrix products."""
    a, b = stored(_keys(new), "match-new"), stored(_keys(old), "match-old")
    count = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    met = count(a, "n").join(count(b, "m"), "key")
    hot = stored(met.where(F.col("n") * F.col("m") > pairs).select(F.struct("key").alias("k"), F.ceil(F.col("m") / rows).cast("long").alias("splits")), "match-hot")
    keyed = lambda df: df.withColumn("k", F.struct("key"))
    cold = lambda df, side: keyed(df).join(hot, "k", "left_anti").select("key", F.col("id").alias(f"{side}_id"))
    shared = cold(a, "new").join(cold(b, "old"), "key").groupBy("new_id", "old_id").agg(F.bool_or(F.col("key").startswith("w ")).alias("words"))
    facts = lambda df, side: df.select(F.col("entry_id").alias(f"{side}_id"), F.col("embedding").alias(f"{side}_v"), F.transform(F.coalesce("repos", F.array().cast("array<string>")), F.lower).alias(f"{side}_r"), tokens(F.col("label")).alias(f"{side}_w"))
    df = shared.join(facts(new, "new"), "new_id").join(facts(old, "old"), "old_id").withColumn("similarity", cosine(F.col("new_v"), F.col("old_v")))
    # A pair may share a hot key besides the one that it met by, so signals are told from the entries.
    two, repo = F.size(F.array_intersect("new_w", "old_w")) >= 2, F.arrays_overlap("new_r", "old_r")
    df = df.withColumn("signals", two.cast("int") + F.coalesce(repo, F.lit(False)).cast("int") + (F.col("similarity") > near).cast("int"))
    df = df.where("signals >= 2 and similarity > 0").select("new_id", "old_id", "similarity", "signals")
    order = W.partitionBy("new_id").orderBy(F.col("similarity").desc(), "old_id")
    best = lambda found: found.withColumn("r", F.row_number().over(order)).where("r = 1").select("new_id", "old_id", "similarity", "signals")
    if hot.isEmpty():
        return best(df)

    id_type = new.schema["entry_id"].dataType
    told = lambda df, side: df.select(F.col("entry_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.filter(F.transform(F.coalesce("repos", F.array().cast("array<string>")), F.lower), lambda r: r.isNotNull()).alias("repos"), tokens(F.col("label")).alias("words"), F.lit(side).alias("side"))
    hot_keys = lambda keys: keyed(keys).join(hot, "k").select("key", "id", "splits")
    held = hot_keys(b).select("key", "id", F.pmod(F.xxhash64("id"), F.col("splits")).alias("split")).join(told(old, 0), "id")
    asked = hot_keys(a).select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split")).join(told(new, 1), "id")
    both = held.unionByName(asked).repartition("key", "split").sortWithinPartitions("key", "split", "side", "id").select("key", "split", "side", "id", "v", "repos", "words")
    out = f"new_id {id_type.simpleString()}, old_id {id_type.simpleString()}, similarity double, signals int"
    found = both.mapInArrow(_blocks(near, to_arrow_schema(_parse_datatype_string(out))), out)
    return best(df.unionByName(found))


def project_matches(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id) of projects (entry_id, label) whose names are equal or one holds the other, in any case; the
    stored one of least id. Names under three signs match on equality only; empty names match nothing.

    Names are compared, not entries, so a name that many projects share is one row. What holds a name holds all of its
    three-sign pieces, so each name meets others by the one of its pieces that the fewest of them hold."""
    name = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    a = stored(new.select(F.col("entry_id").alias("new_id"), name.alias("name")).where("name <> ''"), "project-names-new")
    b = stored(old.groupBy(name.alias("name")).agg(F.min("entry_id").alias("old_id")).where("name <> ''"), "project-names-old")
    asked = a.select("name").distinct()
    within = meetings(asked.select("name"), b.select("name"))
    around = meetings(b.select("name"), asked).select(F.col("held").alias("name"), F.col("name").alias("held"))
    same = asked.select("name", F.col("name").alias("held"))
    met = within.unionByName(around).unionByName(same).join(b.withColumnRenamed("name", "held"), "held").groupBy("name").agg(F.min("old_id").alias("old_id"))
    return a.join(met, "name").select("new_id", "old_id")


def action(similarity: Column, update: float = 0.85, evolve: float = 0.5) -> Column:
    """What becomes of a match, by the cosine of the views; create where there is none."""
    return F.when(similarity.isNull(), "create").when(similarity > update, "update").when(similarity > evolve, "evolve").otherwise("contest")


def merge_log(new: DataFrame, found: DataFrame, update: float = 0.85, evolve: float = 0.5) -> DataFrame:
    """One row for each new entry: its action and the stored entry."""
    ids = new.select(F.col("entry_id").alias("new_id"))
    return ids.join(found, "new_id", "left").select("new_id", "old_id", "similarity", action(F.col("similarity"), update, evolve).alias("action"))


def applied(old: DataFrame, new: DataFrame, log: DataFrame) -> DataFrame:
    """The store after a merge, from entries (entry_id, view, confidence, state, insights array<struct<insight, snippet>>,
    sources, evolution, positions). Several new entries on one stored entry are folded in order of their id; an update
    leaves the view, an evolution replaces it and notes the change, a contest adds a position and marks the state."""
    part = log.join(new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns]), F.col("new_id") == F.col("n_entry_id"))
    many = F.array_sort(F.collect_list(F.struct("new_id", "action", F.col("n_view").alias("view"), F.col("n_confidence").alias("confidence"), F.col("n_insights").alias("insights"), F.col("n_sources").alias("sources"))))
    by = part.where("action <> 'create'").groupBy(F.col("old_id").alias("entry_id")).agg(many.alias("__c"))
    df = old.join(by, "entry_id", "left")
    start = F.struct(*[F.col(c).alias(c) for c in ("view", "confidence", "state", "insights", "sources", "evolution", "positions")])

    def step(s: Column, c: Column) -> Column:
        seen = F.transform(s["insights"], lambda i: F.substring(F.lower(F.trim(i["snippet"])), 1, 50))
        more = F.filter(c["insights"], lambda i: ~F.array_contains(seen, F.substring(F.lower(F.trim(i["snippet"])), 1, 50)))
        keep, contest = c["action"] == "update", c["action"] == "contest"
        change = F.array(F.struct(F.concat(F.substring(s["view"], 1, 50), F.lit(" -> "), F.substring(c["view"], 1, 50)).alias("delta"), F.try_element_at(c["sources"], F.lit(1)).alias("trigger"), s["view"].alias("from_view"), c["view"].alias("to_view")))
        return F.struct(
            F.when(keep, s["view"]).otherwise(c["view"]).alias("view"), F.when(c["action"] == "evolve", c["confidence"]).otherwise(s["confidence"]).alias("confidence"),
            F.when(contest, F.lit("contested")).otherwise(s["state"]).alias("state"), F.when(contest, s["insights"]).otherwise(F.concat(s["insights"], more)).alias("insights"),
            F.array_union(s["sources"], c["sources"]).alias("sources"), F.when(c["action"] == "evolve", F.concat(s["evolution"], change)).otherwise(s["evolution"]).alias("evolution"),
            F.when(contest, F.array_append(s["positions"], c["view"])).otherwise(s["positions"]).alias("positions"),
        )

    folded = F.aggregate(F.coalesce("__c", F.array().cast(by.schema["__c"].dataType)), start, step)
    df = df.withColumn("__s", folded)
    kept = df.select(*[F.col(f"__s.{c}").alias(c) if c in ("view", "confidence", "state", "insights", "sources", "evolution", "positions") else F.col(c) for c in old.columns])
    made = new.join(log.where("action = 'create'").select(F.col("new_id").alias("entry_id")), "entry_id", "left_semi")
    return kept.unionByName(made.select(*old.columns))


def mention_links(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """Entries linked to repositories whose name stands in their view as a word, with confidence 1."""
    words = entries.select("entry_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("view"), F.lit("[a-z0-9_.-]+"), F.lit(0)))).alias("repo"))
    return words.join(repos.select(F.lower("name").alias("repo")).distinct(), "repo").select("entry_id", "repo", F.lit(1.0).alias("confidence"))


def sources_joined(sources: Column) -> Column:
    return F.array_join(F.slice(filled(sources), 1, 3), ",")
