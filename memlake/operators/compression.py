"""Short forms of entries that nothing has touched for long; what they say in full is archived first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.operators.filters import compression_reason
from memlake.plans.tables import stored
from memlake.sources.store import archive_full_content

# Fixed values of the short form.
VIEW, INSIGHTS, INSIGHT, ABILITIES = 200, 3, 150, 2
DELTA = ("Evolved through ", " stages: ", "... \u2192 ", "...")
TRIGGER = "Multiple conversations"
SHOWN = 50


def evolution_summary(evolution: Column) -> Column:
    """Of several changes (delta, trigger, from_view, to_view, ..) one, from the first view to the last, with all else of
    the last; none or one stay as they are."""
    first, last = evolution[0], F.element_at(evolution, -1)
    head = lambda view: F.substring(F.coalesce(view, F.lit("")), 1, SHOWN)
    said = (F.size(evolution).cast("string"), head(first["from_view"]), head(last["to_view"]))
    delta = F.concat(*[part for fixed, text in zip(DELTA, said) for part in (F.lit(fixed), text)], F.lit(DELTA[-1]))
    one = F.array(last.withField("delta", delta).withField("trigger", F.lit(TRIGGER)).withField("from_view", first["from_view"]))
    return F.when(F.size(evolution) > 1, one).otherwise(evolution)


def short_form(entries: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Entries (entry_id, view, insights array<struct<insight, ..>>, abilities, questions, evolution) in their short form:
    a view of 200 signs, three insights, two abilities, no questions, one change.

    ``told`` (entry_id, view, insights array<string>) are a model's words; one row an entry, of several the least. Its
    view, if filled, is taken instead of the entry's first 200 signs. Its insights, if any, replace the texts of the
    entry's first ones, at 150 signs each, and keep their evidence; an entry that a model told of has no more insights
    than it tells, but three where it tells of none. A null list of an entry is empty."""
    columns = entries.columns
    lists = {c: F.coalesce(c, F.array().cast(entries.schema[c].dataType)) for c in ("insights", "abilities", "questions", "evolution")}
    df = entries.withColumns(lists)
    first = F.slice("insights", 1, INSIGHTS)
    view, insights = F.substring("view", 1, VIEW), first
    if told is not None:
        words = told.groupBy("entry_id").agg(F.min(F.struct("view", "insights")).alias("__told"))
        df = df.join(words, "entry_id", "left")
        said = F.slice(F.coalesce(F.col("__told.insights"), F.array().cast("array<string>")), 1, INSIGHTS)
        renewed = F.transform(F.slice("insights", F.lit(1), F.size(said)), lambda i, n: i.withField("insight", F.substring(F.coalesce(F.get(said, n), i["insight"]), 1, INSIGHT)))
        insights = F.when((F.size(said) > 0) & (F.size(first) > 0), renewed).otherwise(first)
        view = F.substring(F.coalesce(F.nullif(F.col("__told.view"), F.lit("")), F.col("view")), 1, VIEW)
    short = {
        "view": view, "insights": insights, "abilities": F.slice("abilities", 1, ABILITIES), "questions": F.slice("questions", 1, 0),
        "evolution": evolution_summary(F.col("evolution")), "detail_level": F.lit("compressed"),
    }
    return df.withColumns(short).select(*dict.fromkeys([*columns, "detail_level"]))


def compress(entries: DataFrame, root: str, now, told: DataFrame | None = None, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(entries, log): every knowledge entry without a ``compression_reason`` (whose ``limits`` may be given) is archived
    in full under ``root`` and then put in its short form; others and projects stay. The log has a row for each knowledge
    entry: entry_id, action (compressed or skipped), reason (null where compressed), full_content_ref.

    Entries need the columns of ``short_form`` and entry_type, detail_level, state, updated_at, access_count,
    full_content_ref, and a ``date`` in each change. The last change is the one of greatest date."""
    last = F.array_max(F.transform("evolution", lambda e: F.try_to_timestamp(e["date"].cast("string"))))
    why = compression_reason(F.col("detail_level"), F.col("state"), F.col("updated_at"), F.coalesce("access_count", F.lit(0)), last, now, **limits)
    marked = entries.select(F.struct(*entries.columns).alias("e"), F.when(F.col("entry_type") == "knowledge", why).otherwise("other").alias("why"))
    # Stored, so that what is archived is what is shortened.
    marked = stored(marked, "compression")
    full = archive_full_content(marked.where("why is null").select("e.*"), root).select(*entries.columns)
    after = marked.where("why is not null").select("e.*").unionByName(short_form(full, told).select(*entries.columns))
    log = marked.where("e.entry_type = 'knowledge'").select("e.entry_id", F.when(F.col("why").isNull(), "compressed").otherwise("skipped").alias("action"), F.col("why").alias("reason"))
    return after, log.join(full.select("entry_id", "full_content_ref"), "entry_id", "left")
