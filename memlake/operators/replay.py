"""Replay: duplicates and contradictions among entries, merging and contesting them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake import policy as P
from memlake.functions.scoring import appended, comparable, jaccard, note, opposing
from memlake.plans.overlaps import Words, common, in_blocks, whole_groups
from memlake.plans.tables import stored


def fingerprints(entries: DataFrame) -> DataFrame:
    """Add fp: entry type and comparable label, null where the label is too short to tell."""
    label = comparable(F.col("label"))
    return entries.withColumn("fp", F.when(F.length(label) >= P.FINGERPRINT_LENGTH, F.concat_ws(":", F.col("entry_type"), label)))


def _views(entries: DataFrame) -> DataFrame:
    """Entries by fp and by view: entries of one fp, type, narrative and confidence share a row, for all that a pair
    of them can say is the same; so copies never make pairs."""
    df = fingerprints(entries).where("fp is not null")
    df = df.withColumns({"narrative": comparable(F.col("narrative")), "low": F.coalesce(F.col("confidence") == "low", F.lit(False))})
    return df.groupBy("fp", "entry_type", "narrative", "low").agg(F.min("entry_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def _shared(entries: DataFrame) -> DataFrame:
    """Views of labels that several entries have, stored; the texts of all others are left alone. The join is on a key of
    its own, so that it has exchanges of its own, of which a hot one can be split."""
    df = fingerprints(entries).where("fp is not null")
    several = df.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.struct("fp").alias("key"))
    df = df.withColumn("key", F.struct("fp")).join(several.hint("shuffle_hash"), "key", "left_semi").drop("key")
    return stored(_views(df), "replay-pairs")


#: Why two views contradict: nothing, opposing markers, or a similarity, by its hundredths as they are written.
REASONS = ("", *[f"opposing markers ({p} vs {n})" for p, n in P.OPPOSING], *[f"same topic has materially different views (similarity={h / 100:.2f})" for h in range(int(P.CONTRADICTION_SIMILARITY * 100 + 0.5) + 1)])
#: The least double that is written as each number of hundredths from 1.
EDGES = np.array([x if f"{x:.2f}" == f"{(h + 1) / 100:.2f}" else np.nextafter(x, 1) for h in range(len(REASONS) - len(P.OPPOSING) - 2) for x in [(2 * h + 1) / 200]])
MET = ("fp", "i", "j")


def _met(views: DataFrame) -> DataFrame:
    """Views in groups of which each pair is in one, with their markers by bits."""
    marks = [F.when(F.col("narrative").contains(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(m for pair in P.OPPOSING for m in pair)]
    df = views.select("fp", "narrative", "low", "first_id", (F.col("entry_type") == "project").alias("project"), reduce(lambda a, b: a.bitwiseOR(b), marks).alias("marks"))
    return in_blocks(df, "fp", "narrative", "low").select(*MET, "second", "narrative", "low", "first_id", "project", "marks")


class _Views:
    """Views of whole groups, in order of their narratives."""

    def __init__(self, batch: pa.RecordBatch):
        self.texts = batch.column("narrative")
        self.words, self.ids = Words(self.texts), batch.column("first_id")
        self.second, self.low = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("second", "low"))
        self.marks, self.signs = batch.column("marks").to_numpy(zero_copy_only=False), pc.binary_length(self.texts).to_numpy(zero_copy_only=False)
        self.known = batch.column("first_id").is_valid().to_numpy(zero_copy_only=False)
        self.batch = batch

    def sides(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that meet: those of two blocks, or of one with itself."""
        rows, second = np.arange(first, end), self.second[first:end]
        return (rows, rows) if self.batch.column("i")[first] == self.batch.column("j")[first] else (rows[~second], rows[second])

    def said(self, a: np.ndarray, b: np.ndarray) -> tuple:
        """(near, reason's place in REASONS, words shared, blank, project) of views ``a`` with views ``b``."""
        both, size = common(self.words, a, b).astype(float), self.words.size
        blank = (size[a] == 0)[:, None] | (size[b] == 0)[None, :]
        near = np.where(blank, 0.0, both / np.where(blank, 1, size[a][:, None] + size[b][None, :] - both))
        project, reason = self.batch.column("project")[a[0]].as_py(), np.zeros(near.shape, np.int8)
        if project is False:
            free = ~blank & ~self.low[a][:, None] & ~self.low[b][None, :] & (near <= P.CONTRADICTION_SIMILARITY)
            reason[free] = np.searchsorted(EDGES, near[free], "right") + 1 + len(P.OPPOSING)
            if self.marks[a].any() and self.marks[b].any():
                for k in reversed(range(len(P.OPPOSING))):
                    (for_a, not_a), (for_b, not_b) = ((self.marks[x] & 1 << 2 * k > 0, self.marks[x] & 2 << 2 * k > 0) for x in (a, b))
                    reason[((for_a[:, None] & not_b[None, :]) | (not_a[:, None] & for_b[None, :])) & ~blank] = k + 1
        return near, reason, both, blank, project

    def compatible(self, a: np.ndarray, b: np.ndarray, said: tuple) -> np.ndarray:
        """Of each pair 1, 0 or, where it hangs on an unknown type, 2."""
        near, reason, both, blank, project = said
        if project:
            return np.ones(near.shape, np.int8)
        against = (reason > 0) & (reason <= len(P.OPPOSING))
        alike = near >= P.COMPATIBLE_SIMILARITY
        # A text within another has all words but its first and last one whole.
        signs, size = (self.signs[a][:, None], self.signs[b][None, :]), (self.words.size[a][:, None], self.words.size[b][None, :])
        short = np.where(signs[0] < signs[1], size[0], size[1])
        x, y = np.nonzero(~alike & ~blank & ~against & (signs[0] != signs[1]) & (both >= short - 2))
        if len(x):
            one, other = self.texts.take(pa.array(a)).to_pylist(), self.texts.take(pa.array(b)).to_pylist()
            alike[x, y] = [one[k] in other[m] or other[m] in one[k] for k, m in zip(x.tolist(), y.tolist(), strict=True)]
        return np.where(blank | (alike & ~against), 1, 2 if project is None else 0).astype(np.int8)


def _as_lists(counts: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values, type=kind)


def _listed(v: _Views, a: np.ndarray, b: np.ndarray, schema: pa.Schema):
    """Of each view those after it in order, and what the pair says."""
    kind = schema.field("met").type
    said = v.said(a, b)
    near, told, later = said[0], said[1] * np.int16(3) + v.compatible(a, b, said), a[:, None] < b[None, :]
    for own, other, near, told, of in ((a, b, near, told, later), (b, a, near.T, told.T, ~later.T))[: 1 if a is b else 2]:
        some, at = of.any(1), np.nonzero(of)
        if some.any():
            pairs = pa.StructArray.from_arrays([v.ids.take(pa.array(other[at[1]])), pa.array(near[at]), pa.array(told[at])], fields=list(kind.value_type))
            mine = pa.array(own[some])
            yield pa.RecordBatch.from_arrays([v.batch.column("fp").take(mine), v.ids.take(mine), _as_lists(of.sum(1)[some], pairs, kind)], schema=schema)


def _against(v: _Views, a: np.ndarray, b: np.ndarray, schema: pa.Schema):
    """Of each view those that contradict it, and why, as bits of REASONS."""
    kind = schema.field("others").type
    reason = v.said(a, b)[1].astype(np.int64)
    if a is b:
        np.fill_diagonal(reason, 0)
    bits = np.where(reason > 0, np.int64(1) << reason, 0)
    for own, other, why in ((a, b, bits), (b, a, bits.T))[: 1 if a is b else 2]:
        some = (why != 0).any(1) & v.known[own]
        if some.any():
            why, mine = why[some], pa.array(own[some])
            of = (why != 0) & v.known[other][None, :]
            others = v.ids.take(pa.array(other[np.nonzero(of)[1]]))
            yield pa.RecordBatch.from_arrays([v.ids.take(mine), pa.array(np.bitwise_or.reduce(why, 1)), _as_lists(of.sum(1), others, kind)], schema=schema)


def _by_blocks(views: DataFrame, how, out: T.StructType) -> DataFrame:
    """What ``how`` makes of all groups; small batches go out together."""
    schema = to_arrow_schema(out)

    def run(batches):
        held, size = [], 0
        for batch, ends in whole_groups(batches, MET):
            v = _Views(batch)
            for first, end in zip(ends, ends[1:], strict=False):
                a, b = v.sides(first, end)
                for told in how(v, a, b, schema) if len(a) and len(b) else ():
                    held.append(told)
                    size += told.nbytes
                    if size > 4_000_000:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return _met(views).mapInArrow(run, out)


def view_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of different views of one fp: whether they are compatible duplicates, and why they contradict.

    Views of labels that several entries have are stored; pairs are made block by block from counts of shared words, and
    leave as a row for each view and block with a list of those that come later."""
    return _pairs(_shared(entries))


def _pairs(views: DataFrame) -> DataFrame:
    kind = views.schema["first_id"].dataType
    pair = T.StructType([T.StructField("b_id", kind), T.StructField("near", T.DoubleType(), False), T.StructField("told", T.ShortType(), False)])
    met = _by_blocks(views, _listed, T.StructType([T.StructField("fp", T.StringType()), T.StructField("a_id", kind), T.StructField("met", T.ArrayType(pair, False))]))
    told = F.col("told").cast("int")
    code, reasons = F.floor(told / 3).cast("int"), F.array(F.lit(None).cast("string"), *map(F.lit, REASONS[1:]))
    return met.select("fp", "a_id", F.inline("met")).select("fp", "a_id", "b_id", "near", F.when(told % 3 < 2, told % 3 == 1).alias("compatible"), F.get(reasons, code).alias("reason"))


def contradictions(entries: DataFrame) -> DataFrame:
    """(entry_id, reasons, conflicts): the same as ``rolled_up(view_pairs(entries))``, of which no pair becomes a row. What
    a view contradicts leaves a block as a list, and the lists of a view are put together."""
    views = _shared(entries)
    kind = views.schema["first_id"].dataType
    out = T.StructType([T.StructField("entry_id", kind), T.StructField("why", T.LongType(), False), T.StructField("others", T.ArrayType(kind, False), False)])
    lists = _by_blocks(views, _against, out).repartition("entry_id")
    df = lists.groupBy("entry_id").agg(F.bit_or("why").alias("why"), F.collect_list("others").alias("others"))
    reasons = [F.when(F.col("why").bitwiseAND(F.lit(1 << REASONS.index(r)).cast("long")) != 0, F.lit(r)) for r in sorted(REASONS[1:])]
    return df.select("entry_id", F.array_compact(F.array(*reasons)).alias("reasons"), F.array_distinct(F.sort_array(F.flatten("others"))).alias("conflicts"))


def _decided(facts: DataFrame) -> DataFrame:
    """Add ``against`` and ``agree``, each true, false or null for unknown, to what a label's views say: ``opposed`` (the
    first pair of markers they hold on different sides), and for views that can diverge (e_) and that have a text (t_)
    their count, word counts, Jaccard with the pivot, and whether one is known to be unlike it; ``core`` words are in all.

    Of two sets the Jaccard is at most the ratio of their sizes, and at most 1 less the difference of their values with
    a third set; it is at least the sum of those values less 1, and at least the core's share of both."""
    sure, t, c = 1e-9, P.CONTRADICTION_SIMILARITY, P.COMPATIBLE_SIMILARITY
    core = lambda high: F.coalesce(F.col("core") / (2 * F.col(high) - F.col("core")), F.lit(0.0))
    apart = F.col("e_unlike") | (F.col("e_least") / F.col("e_most") <= t) | (F.col("e_high") - F.col("e_low") >= 1 - t + sure)
    near = (2 * F.col("e_low") - 1 > t + sure) | (core("e_most") > t + sure)
    diverge = F.when(F.col("project") | (F.col("e_n") < 2), False).when(apart, True).when(near, False)
    against = F.when(F.col("opposed").isNotNull(), True).otherwise(diverge)
    alike = (2 * F.col("t_low") - 1 >= c + sure) | (core("t_most") >= c + sure)
    agree = F.when(F.col("project") | (F.col("t_n") < 2), True).when(F.col("t_unlike"), False).when(alike, True)
    return facts.withColumns({"against": against, "agree": F.when(F.col("opposed").isNotNull(), False).otherwise(agree)})


def _facts(views: DataFrame) -> DataFrame:
    """What the views of each label say about all pairs of them, in one pass: markers, word counts, and values with one
    view, the pivot. A label's views are summed up where they are; only the pivot is sent to them."""
    pivot = views.groupBy(F.struct("fp").alias("key")).agg(F.min(F.struct("first_id", "low", "narrative", "words")).alias("p"))
    v = views.withColumn("key", F.struct("fp")).join(pivot, "key")
    own = (F.col("narrative") == F.col("p.narrative")) & (F.col("low") == F.col("p.low"))
    text, pivotal = F.col("narrative") != "", F.col("p.narrative") != ""
    free = text & ~F.col("low")
    v = v.withColumn("j", jaccard(F.col("words"), F.col("p.words")))
    within = F.col("narrative").contains(F.col("p.narrative")) | F.col("p.narrative").contains(F.col("narrative"))
    has = lambda m: F.col("narrative").contains(m)
    sides = lambda p, n: (F.count_if(has(p)) > 0) & (F.count_if(has(n)) > 0) & (F.count_if(has(p) | has(n)) > 1)
    opposed = F.coalesce(*[F.when(sides(p, n), F.lit(f"opposing markers ({p} vs {n})")) for p, n in P.OPPOSING])
    size, when = F.size("words"), lambda ok, x: F.when(ok, x)
    unlike = lambda ok, cond: F.coalesce(F.bool_or(ok & ~own & cond), F.lit(False))
    return v.groupBy("fp").agg(
        F.bool_or(F.col("entry_type") == "project").alias("project"), opposed.alias("opposed"), F.count(F.lit(1)).alias("views"),
        F.count_if(free).alias("e_n"), F.min(when(free, size)).alias("e_least"), F.max(when(free, size)).alias("e_most"), F.min(when(free, F.col("j"))).alias("e_low"), F.max(when(free, F.col("j"))).alias("e_high"),
        unlike(free & pivotal & ~F.col("p.low"), F.col("j") <= P.CONTRADICTION_SIMILARITY).alias("e_unlike"),
        F.count_if(text).alias("t_n"), F.max(when(text, size)).alias("t_most"), F.min(when(text, F.col("j"))).alias("t_low"),
        unlike(text & pivotal, (F.col("j") < P.COMPATIBLE_SIMILARITY) & ~within).alias("t_unlike"),
    ).withColumn("opposed", F.when(~F.col("project"), F.col("opposed")))


def _open() -> F.Column:
    return F.col("against").isNull() | (~F.col("against") & F.col("agree").isNull())


def plans(entries: DataFrame) -> DataFrame:
    """(fp, n_entries, plan, reason): contest where any pair contradicts, merge where all pairs are compatible, else
    nothing. Equal views are compatible, so a group of copies is a merge. ``reason`` is null where it took no pair to
    know that views diverge.

    Pairs are looked at only where bounds leave a doubt: one pass over a label's views with a pivot settles most, the
    words that all of its views share settle most others, and what is left is compared pair by pair."""
    groups = fingerprints(entries).where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n_entries")).where("n_entries > 1")
    views = _views(entries).withColumn("words", F.array_distinct(F.array_remove(F.split("narrative", " "), "")))
    many = views.groupBy(F.struct("fp").alias("key")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    views = stored(views.withColumn("key", F.struct("fp")).join(many, "key", "left_semi").drop("key"), "replay-views")
    plan = F.when(F.coalesce("against", F.lit(False)), "contest").when(F.coalesce("agree", F.lit(True)), "merge").otherwise("none")
    with_plans = lambda told: groups.join(told, "fp", "left").select("fp", "n_entries", plan.alias("plan"), "reason")
    doubts = Observation()
    facts = _decided(_facts(views).withColumn("core", F.lit(0).cast("long")))
    facts = stored(facts.observe(doubts, F.count_if(_open()).alias("n")), "replay-facts")
    if doubts.get["n"] == 0:
        return with_plans(facts.select("fp", "against", "agree", F.col("opposed").alias("reason")))
    doubt = facts.where(_open()).select("fp", "views")
    words = views.where("narrative <> ''").join(doubt, "fp").select("fp", F.explode("words").alias("word")).groupBy("fp", "word").agg(F.count(F.lit(1)).alias("n"))
    held = facts.where(_open()).drop("core", "against", "agree")
    core = words.join(held.select("fp", "t_n"), "fp").where("n = t_n").groupBy("fp").agg(F.count(F.lit(1)).alias("core"))
    again = stored(_decided(held.join(core, "fp", "left").withColumn("core", F.coalesce("core", F.lit(0).cast("long")))), "replay-core")
    left = again.where(_open()).select("fp")
    exact = _pairs(views.join(left, "fp", "left_semi")).groupBy("fp").agg(F.bool_or(F.col("reason").isNotNull()).alias("against"), F.bool_and("compatible").alias("agree"), F.min("reason").alias("reason"))
    told = facts.where(~_open()).unionByName(again.where(~_open()).select(facts.columns)).select("fp", "against", "agree", F.col("opposed").alias("reason")).unionByName(exact)
    return with_plans(told)


CANONICAL = ("tier", "-mention_count", "-access_count", "-salience")


def canonical_rank(entries: DataFrame) -> DataFrame:
    """Add rank within fp: tier, mentions, access, salience, last change, id."""
    order = [F.col("tier"), F.col("mention_count").desc(), F.col("access_count").desc(), F.col("salience").desc(), F.col("updated_at").desc_nulls_last(), F.col("entry_id")]
    return entries.withColumn("rank", F.row_number().over(W.partitionBy("fp").orderBy(*order)))


def merged(entries: DataFrame) -> DataFrame:
    """One canonical row for each fp that merges: distinct sources, mentions from them, access summed, first and last
    times, the first goal that is filled in, in order of rank. Needs fp, rank and the columns read here."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("v")))), lambda s: s["v"])
    sources = F.array_distinct(F.flatten(ordered("sources")))
    return entries.groupBy("fp").agg(
        F.min_by("entry_id", "rank").alias("entry_id"), sources.alias("sources"), F.greatest(F.lit(1), F.size(sources)).alias("mention_count"), F.sum("access_count").alias("access_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("merged_from"),
        F.try_element_at(F.filter(ordered("goal"), lambda g: g.isNotNull() & (g != "")), F.lit(1)).alias("goal"),
    )


def summed_weights(entries: DataFrame) -> DataFrame:
    """(fp, source_weights): maps added up key by key."""
    parts = entries.select("fp", F.explode("source_weights").alias("k", "w")).groupBy("fp", "k").agg(F.sum("w").alias("w"))
    return parts.groupBy("fp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "w")))).alias("source_weights"))


def rolled_up(pairs: DataFrame) -> DataFrame:
    """(entry_id, reasons, conflicts) from (a_id, b_id, reason): of each entry its reasons and the ids in conflict, sorted."""
    both = pairs.where("reason is not null").select(F.explode(F.array(F.struct(F.col("a_id").alias("entry_id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("entry_id"), F.col("a_id").alias("other")))).alias("p"), "reason")
    return both.groupBy("p.entry_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set("p.other")).alias("conflicts"))


def _rolled(found: DataFrame) -> DataFrame:
    return rolled_up(found) if "reason" in found.columns else found


def _links(conflicts: str) -> F.Column:
    return F.transform(conflicts, lambda i: F.struct(i.alias("knowledge_id"), F.lit("contradicts").alias("relationship")))


def contested(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Contradictions by entry, from pairs (a_id, b_id, reason) or ``contradictions``: reasons and ids in conflict, sorted;
    the entry contested and linked to them by ``contradicts``."""
    return entries.drop("state").join(_rolled(found), "entry_id").withColumns({"state": F.lit("contested"), "links": _links("conflicts")})


def internal_contradiction(views) -> F.Column:
    """Of an array of views, why the first pair (by place) that contradicts does, or null. Pairs are of one entry."""
    said = F.filter(F.transform(views, comparable), lambda v: v != "")
    words = lambda v: F.array_distinct(F.split(v, " "))
    pair = lambda a, b: F.coalesce(
        F.concat(F.lit("internal positions contain "), opposing(a, b)),
        F.when(jaccard(words(a), words(b)) <= P.INTERNAL_SIMILARITY, F.concat(F.lit("internal positions materially diverge (similarity="), F.format_number(jaccard(words(a), words(b)), 2), F.lit(")"))),
    )
    rows = F.flatten(F.transform(said, lambda a, i: F.transform(F.slice(said, i + 2, F.size(said)), lambda b: pair(a, b))))
    return F.try_element_at(F.filter(rows, lambda r: r.isNotNull()), F.lit(1))


#: Lists and texts of entries that a merge unites, where the table has them.
LISTS = ("sources", "source_messages", "insights", "abilities", "questions", "positions", "evolution", "decisions", "tools", "history", "repos", "links")
TEXTS = ("goal", "phase", "blocked")


def _order(df: DataFrame):
    """Which of entries that merge comes first: the least, as in ``canonical_rank``."""
    return F.struct(
        F.coalesce("tier", F.lit(3)).alias("tier"), (-F.coalesce("mention_count", F.lit(1))).alias("m"), (-F.coalesce("access_count", F.lit(0))).alias("a"), (-F.coalesce("salience", F.lit(0.0))).alias("s"),
        F.coalesce(-F.unix_micros("updated_at"), F.lit(2**62)).alias("u"), "entry_id",
    )


def consolidated(entries: DataFrame, fps: DataFrame, run_id: str, now) -> tuple[DataFrame, DataFrame]:
    """(entries, gone): live entries of the labels ``fps`` (fp) put into their first one, and (entry_id, canonical_id) of
    the others, to be archived. Lists keep each member once, in order of the entries and of their places; counts add up,
    but mentions are the distinct sources where there are any; the earliest and latest times and the first text that
    is filled in stay. The others' access counters start anew.

    No group is gathered: the first entry is a grouped minimum, and of a list's members each is kept once before they
    are put together, so what meets in a row is what the merged entry holds."""
    live = fingerprints(entries).where(~F.coalesce("archived", F.lit(False)))
    keyed = live.join(fps.select("fp").distinct(), "fp").withColumn("__o", _order(entries))
    there = lambda names: [c for c in names if c in entries.columns]
    filled_in = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("__o")))
    main = keyed.groupBy("fp").agg(
        F.min("__o")["entry_id"].alias("__id"), F.count(F.lit(1)).alias("__n"), F.sum("access_count").alias("__access"), F.sum("mention_count").alias("__mentions"),
        *[F.min(c).alias(f"__{c}") for c in there(("first_seen", "created_at"))], *[F.max(c).alias(f"__{c}") for c in there(("last_seen", "last_accessed", "updated_at"))],
        *[filled_in(c).alias(f"__{c}") for c in there(TEXTS)],
    ).where("__n > 1")
    for c in there(LISTS):
        each = keyed.select("fp", "__o", F.posexplode(c).alias("at", "v")).groupBy("fp", "v").agg(F.min(F.struct("__o", "at")).alias("at"))
        main = main.join(each.groupBy("fp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(f"__{c}")), "fp", "left")
    gone = keyed.join(main.select("fp", "__id"), "fp").where("entry_id <> __id").select("entry_id", F.col("__id").alias("canonical_id"))
    df = entries.join(main.drop("fp"), entries["entry_id"] == main["__id"], "left").join(gone.select(F.col("entry_id").alias("__other")), F.col("entry_id") == F.col("__other"), "left")
    into, other = F.col("__id").isNotNull(), F.col("__other").isNotNull()
    put = {c: F.when(into, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in there(("first_seen", "created_at", "last_seen", "last_accessed") + TEXTS + LISTS)}
    mentions = F.when(F.size("__sources") > 0, F.size("__sources")).otherwise(F.col("__mentions")).cast(entries.schema["mention_count"].dataType) if "sources" in entries.columns else F.col("__mentions")
    put |= {
        "mention_count": F.when(into, F.greatest(F.lit(1), mentions)).otherwise(F.col("mention_count")),
        "access_count": F.when(into, F.col("__access")).when(other, 0).otherwise(F.col("access_count")), "updated_at": F.when(into, F.greatest("__updated_at", now)).otherwise(F.col("updated_at")),
    }
    if "last_accessed" in put:
        put["last_accessed"] = F.when(~other, put["last_accessed"])
    if "notes" in entries.columns:
        told = note(now.cast("string"), F.lit("cycle"), F.lit("merge_duplicate_entries"), F.concat(F.lit("merged "), (F.col("__n") - 1).cast("string"), F.lit(f" entries (run {run_id})")))
        put["notes"] = F.when(into, appended(F.col("notes"), told, 20)).otherwise(F.col("notes"))
    return df.withColumns(put).select(*entries.columns), gone


def marked(entries: DataFrame, found: DataFrame) -> DataFrame:
    """All entries, those in ``found``, pairs (a_id, b_id, reason) or ``contradictions``, contested and, where the table has
    links and notes, linked to what they contradict and with a note of why. Links are made once all is joined, so that
    only ids are moved."""
    found = _rolled(found).select(F.col("entry_id").alias("__c"), F.col("conflicts").alias("__conflicts"), F.array_join("reasons", "; ").alias("__why"))
    df = entries.join(found, F.col("entry_id") == F.col("__c"), "left")
    links = _links("__conflicts")
    put = {"state": F.when(F.col("__c").isNotNull(), "contested").otherwise(F.col("state"))}
    if "links" in entries.columns:
        put["links"] = F.when(F.col("__c").isNull(), F.col("links")).when(F.size("links") > 0, F.array_union("links", links)).otherwise(links)
    if "notes" in entries.columns:
        put["notes"] = F.when(F.col("__c").isNotNull(), appended(F.col("notes"), F.concat(F.lit("contested: "), "__why"), 20)).otherwise(F.col("notes"))
    return df.withColumns(put).select(*entries.columns)
