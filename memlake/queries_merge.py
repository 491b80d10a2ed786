"""Registered queries of merging, compression and upkeep over whole texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.operators import compression, merge, parse, replay, upkeep
from memlake.plans.tables import fresh_folder
from memlake.queries import NOW, ORACLES, PAIRS_SQL, _sides, query, raw_entries, table
from memlake.sources import store

# ---------------------------------------------------------------- the store after a merge

MERGED_SQL = f"""WITH log AS ({ORACLES["merge_actions"]}),
e AS (SELECT doc_id AS id, coalesce(text, '') AS view, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, string_split(coalesce(text, ''), '. ') AS said, ['c' || doc_id % 50, 'd' || doc_id] AS sources FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
o AS (SELECT * FROM e WHERE id % 4 <> 0), m AS (SELECT log.old_id, log.action, e.* FROM log JOIN e ON e.id = log.new_id WHERE action <> 'create'),
told AS (SELECT old_id, id, view, lag(view) OVER (PARTITION BY old_id ORDER BY id) AS before, action FROM m WHERE action <> 'update'),
views AS (SELECT t.old_id, max_by(t.view, t.id) AS view, bool_or(action = 'contest') AS contested, max_by(e.confidence, t.id) FILTER (action = 'evolve') AS confidence,
  string_agg(substr(coalesce(before, o.view), 1, 50) || ' -> ' || substr(t.view, 1, 50), '|' ORDER BY t.id) FILTER (action = 'evolve') AS evolution, string_agg(t.view, '|' ORDER BY t.id) FILTER (action = 'contest') AS positions
  FROM told t JOIN e ON e.id = t.id JOIN o ON o.id = t.old_id GROUP BY t.old_id),
steps AS (SELECT id AS entry_id, -1 AS step, TRUE AS adds, said, sources FROM o UNION ALL SELECT old_id, id, action <> 'contest', said, sources FROM m),
i AS (SELECT entry_id, step, unnest(said) AS v, generate_subscripts(said, 1) AS p FROM steps WHERE adds),
ik AS (SELECT *, min(step) OVER (PARTITION BY entry_id, substr(lower(trim(v)), 1, 50)) AS first FROM i), il AS (SELECT entry_id, string_agg(v, '|' ORDER BY step, p) AS insights FROM ik WHERE step = first GROUP BY entry_id),
s AS (SELECT entry_id, v, min(struct_pack(step := step, p := p)) AS place FROM (SELECT entry_id, step, unnest(sources) AS v, generate_subscripts(sources, 1) AS p FROM steps) GROUP BY entry_id, v), sl AS (SELECT entry_id, string_agg(v, ',' ORDER BY place) AS sources FROM s GROUP BY entry_id)
SELECT o.id AS entry_id, sha256(coalesce(v.view, o.view)) AS view_sha256, coalesce(v.confidence, o.confidence) AS confidence, CASE WHEN v.contested THEN 'contested' ELSE 'active' END AS state, sha256(il.insights) AS insights_sha256, sl.sources,
  coalesce(v.evolution, '') AS evolution, sha256(coalesce(v.positions, '')) AS positions_sha256 FROM o JOIN il ON il.entry_id = o.id JOIN sl ON sl.entry_id = o.id LEFT JOIN views v ON v.old_id = o.id
UNION ALL SELECT e.id, sha256(view), confidence, 'active', sha256(array_to_string(said, '|')), array_to_string(sources, ','), '', sha256('') FROM e JOIN log ON log.new_id = e.id WHERE action = 'create'"""


def _stored_form(sides: DataFrame, documents: DataFrame) -> DataFrame:
    d, text = F.col("entry_id"), F.coalesce("text", F.lit(""))
    change = "array<struct<delta:string,trigger:string,from_view:string,to_view:string>>"
    df = sides.select("entry_id").join(documents.select(F.col("doc_id").alias("entry_id"), "text"), "entry_id")
    return df.select(
        "entry_id", text.alias("view"), F.when(d % 3 == 0, "high").when(d % 3 == 1, "medium").otherwise("low").alias("confidence"), F.lit("active").alias("state"),
        F.transform(F.split(text, r"\. "), lambda s: F.struct(s.alias("insight"), s.alias("snippet"))).alias("insights"),
        F.array(F.concat(F.lit("c"), (d % 50).cast("string")), F.concat(F.lit("d"), d.cast("string"))).alias("sources"), F.array().cast(change).alias("evolution"), F.array().cast("array<string>").alias("positions"),
    )


@query(MERGED_SQL)
def merged_store(spark, sf_dir):
    """The store after updates, evolutions and contests by the matches of ``merge_actions``: whole views and lists."""
    new, old = _sides(spark, sf_dir)
    log = merge.merge_log(new, merge.matches(new, old, near=0.25), 0.4, 0.3)
    documents = table(spark, sf_dir, "documents")
    after = merge.applied(_stored_form(old, documents), _stored_form(new, documents), log)
    joined = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "|")
    return after.select(
        "entry_id", F.sha2("view", 256).alias("view_sha256"), "confidence", "state", F.sha2(joined("insights", "insight"), 256).alias("insights_sha256"), F.array_join("sources", ",").alias("sources"),
        joined("evolution", "delta").alias("evolution"), F.sha2(F.array_join("positions", "|"), 256).alias("positions_sha256"),
    )


@query("""WITH n AS (SELECT DISTINCT lower(trim(p_name)) AS a FROM part), o AS (SELECT lower(trim(p_brand || ' ' || p_name)) AS b, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
m AS (SELECT a, min(id) AS id FROM n JOIN o ON a = b OR (least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a))) WHERE a <> '' AND b <> '' GROUP BY a)
SELECT p_partkey AS new_id, m.id AS old_id FROM part JOIN m ON m.a = lower(trim(p_name))""")
def project_matches(spark, sf_dir):
    """Parts as projects: new ones by name, stored ones by brand and name."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("entry_id"), F.concat_ws(" ", "p_brand", "p_name").alias("label"))
    return merge.project_matches(p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("label")), old)


# ---------------------------------------------------------------- compression


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), '. ') AS s, string_split(coalesce(text, ''), chr(10)) AS l, doc_id % 3 AS n FROM documents WHERE doc_id % 5 <> 0),
r AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'already_compressed' WHEN doc_id % 11 = 0 THEN 'contested' WHEN doc_id % 200 <= 90 THEN 'recently_updated' WHEN doc_id % 4 >= 3 THEN 'often_accessed' WHEN n > 0 AND doc_id % 120 <= 60 THEN 'recently_evolved' END AS reason FROM d),
k AS (SELECT *, reason IS NULL AS short, doc_id % 7 = 0 AS told FROM r)
SELECT doc_id AS entry_id, CASE WHEN short THEN 'compressed' ELSE 'skipped' END AS action, reason, CASE WHEN NOT short THEN sha256(t) WHEN told THEN sha256(substr(s[len(s)], 1, 200)) ELSE sha256(substr(t, 1, 200)) END AS view_sha256,
  array_to_string(CASE WHEN NOT short THEN s WHEN told THEN [substr(reverse(s[1]), 1, 150)] ELSE s[1:3] END, '|') AS insights, array_to_string(CASE WHEN short THEN l[1:2] ELSE l END, '|') AS abilities, CASE WHEN short THEN 0 ELSE 1 END AS questions,
  CASE n WHEN 0 THEN '' WHEN 1 THEN 'first' ELSE CASE WHEN short THEN 'Evolved through 2 stages: ' || substr(t, 1, 50) || '... → ' || substr(s[len(s)], 1, 50) || '...' ELSE 'first|second' END END AS evolution, CASE WHEN short THEN sha256(t) END AS archived_sha256 FROM k""")
def compressed_entries(spark, sf_dir):
    """Entries over whole documents that nothing has touched for long, in their short form, with what the archive holds
    of them; for every seventh a model's words are made of the text."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents")
    said = F.split(text, r"\. ")
    ago = lambda n: F.lit(NOW).cast("timestamp") - F.make_dt_interval((d % n).cast("int"))
    change = lambda delta, a, b: F.struct(F.lit(delta).alias("delta"), F.lit("talk").alias("trigger"), a.alias("from_view"), b.alias("to_view"), ago(120).cast("string").alias("date"))
    both = F.array(change("first", text, said[0]), change("second", said[0], F.element_at(said, -1)))
    e = docs.select(
        d.alias("entry_id"), F.when(d % 5 == 0, "project").otherwise("knowledge").alias("entry_type"), F.when(d % 6 == 0, "compressed").otherwise("full").alias("detail_level"), F.when(d % 11 == 0, "contested").otherwise("active").alias("state"),
        ago(200).alias("updated_at"), (d % 4).cast("int").alias("access_count"), F.lit(None).cast("string").alias("full_content_ref"), text.alias("view"), F.transform(said, lambda s: F.struct(s.alias("insight"), s.alias("snippet"))).alias("insights"),
        F.split(text, "\n").alias("abilities"), F.array(F.lit("why")).alias("questions"), F.slice(both, F.lit(1), (d % 3).cast("int")).alias("evolution"),
    )
    told = docs.where("doc_id % 7 = 0").select(d.alias("entry_id"), F.element_at(said, -1).alias("view"), F.array(F.reverse(said[0])).alias("insights"))
    root = fresh_folder(spark, "compressed")
    after, log = compression.compress(e, root, NOW, told)
    full = store.full_content(spark, root, log).select("entry_id", F.sha2(F.get_json_object("content", "$.view"), 256).alias("archived_sha256"))
    joined = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "|")
    return log.join(after, "entry_id").join(full, "entry_id", "left").select(
        "entry_id", "action", "reason", F.sha2("view", 256).alias("view_sha256"), joined("insights", "insight").alias("insights"), F.array_join("abilities", "|").alias("abilities"), F.size("questions").alias("questions"),
        joined("evolution", "delta").alias("evolution"), "archived_sha256",
    )


# ---------------------------------------------------------------- contests, evidence, upkeep


@query(f"""{PAIRS_SQL}, x AS (SELECT a_id AS id, b_id AS other, reason FROM pairs WHERE reason IS NOT NULL UNION ALL SELECT b_id, a_id, reason FROM pairs WHERE reason IS NOT NULL),
c AS (SELECT id, array_to_string(list_sort(list_distinct(list(other))), ',') AS links, 'contested: ' || array_to_string(list_sort(list_distinct(list(reason))), '; ') AS notes FROM x GROUP BY id)
SELECT entry_id, CASE WHEN c.id IS NOT NULL THEN 'contested' ELSE state END AS state, coalesce(c.links, '') AS links, coalesce(c.notes, '') AS notes FROM entries LEFT JOIN c ON id = entry_id""")
def contested_entries(spark, sf_dir):
    e = raw_entries(spark, sf_dir).withColumns({"links": F.array().cast("array<struct<knowledge_id:bigint,relationship:string>>"), "notes": F.array().cast("array<string>")})
    after = replay.marked(e, replay.contradictions(e))
    return after.select("entry_id", "state", F.array_join(F.transform("links", lambda x: x["knowledge_id"].cast("string")), ",").alias("links"), F.array_join("notes", "|").alias("notes"))


@query(r"""WITH e AS (SELECT conv_id || ':' || turn AS entry_id, CASE WHEN turn % 5 = 0 THEN split_part(text, ' ', 1) ELSE text END AS label, CASE WHEN turn % 3 = 0 THEN [] ELSE [conv_id || ':' || turn, conv_id || ':' || (turn + 1)] END AS ids FROM conversations),
u AS (SELECT entry_id, unnest(ids) AS id FROM e)
SELECT entry_id, 'short_label' AS issue FROM e WHERE len(regexp_split_to_array(trim(coalesce(label, '')), '\s+')) < 2 UNION ALL SELECT entry_id, 'insight_without_messages:0' FROM e WHERE len(ids) = 0
UNION ALL SELECT DISTINCT entry_id, 'unknown_message:' || id FROM u WHERE id NOT IN (SELECT conv_id || ':' || turn FROM conversations)""")
def evidence_issues(spark, sf_dir):
    """An entry of each turn, with the turn and the next as its evidence; after the last there is none."""
    c = table(spark, sf_dir, "conversations")
    at = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + n).cast("string"))
    ids = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(at(0), at(1)))
    e = c.select(at(0).alias("entry_id"), F.when(F.col("turn") % 5 == 0, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.col("text")).alias("label"), F.array(F.struct(F.col("text").alias("insight"), ids.alias("message_ids"))).alias("insights"))
    return upkeep.evidence_issues(e, c.select(at(0).alias("message_id")))


@query("SELECT user_id AS conv_id, event_id % 9 AS message_id FROM events WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = user_id AND c.turn = event_id % 9)")
def unknown_messages(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 9).alias("message_id"))
    return parse.unknown_message_ids(asked, table(spark, sf_dir, "conversations"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT d.doc_id AS entry_id FROM documents d LEFT JOIN l USING (doc_id)
WHERE (coalesce(q, 0) <> 1 OR d.doc_id % 6 = 0) AND d.doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')""")
def classification_queue(spark, sf_dir):
    """Entries still to classify, less those that a checkpoint names."""
    status = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("entry_id")).agg(F.when(F.max("quality") == 1, "complete").otherwise("pending").alias("classification_status"))
    e = raw_entries(spark, sf_dir).join(status, "entry_id", "left").withColumn("context_type", F.when(F.col("entry_id") % 6 != 0, F.col("context_type")))
    done = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("entry_id")).distinct()
    return upkeep.pending(e, done=done).select("entry_id")


def _runs(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("run_id"), F.col("ts").cast("timestamp").alias("run_at"), F.when(i % 4 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("event_type") == "click", "cron").otherwise("manual").alias("trigger"),
        (i % 10 == 0).alias("dry_run"), (F.col("event_type") != "view").alias("set_as_latest"),
    )


@query(f"""SELECT event_id AS run_id, array_to_string(list_filter([CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 1 DAY + INTERVAL 430 MINUTE THEN 'before_window' END, CASE WHEN ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY + INTERVAL 490 MINUTE THEN 'late_start' END,
CASE WHEN event_id % 4 = 0 THEN 'status' END, CASE WHEN event_type <> 'click' THEN 'trigger' END, CASE WHEN event_id % 10 = 0 THEN 'dry_run' END], lambda x: x IS NOT NULL), ',') AS issues FROM events""")
def run_issues(spark, sf_dir):
    return upkeep.run_issues(_runs(spark, sf_dir), NOW)


@query("""WITH r AS (SELECT event_id, ts, event_type <> 'view' AND event_id % 4 <> 0 AS good FROM events) SELECT (SELECT event_id FROM r WHERE good ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_run, (SELECT event_id FROM r ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_attempt""")
def latest_runs(spark, sf_dir):
    return upkeep.latest_run(_runs(spark, sf_dir))


@query("SELECT lower(replace(text, ' ', '_')) AS label, doc_id AS entry_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def secondary_index(spark, sf_dir):
    """Entries by their whole text as the label."""
    return store.by_key(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("label")), "label")
