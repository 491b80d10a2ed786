"""Registered queries of views, conversion, reports and upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators import consolidate, lifecycle, mail, mutate, parse, replay, upkeep, views
from memlake.plans.tables import numbered
from memlake.queries import ENTRIES_SQL, NOW, PAIRS_SQL, entries, query, raw_entries, table

#: Columns of entries over documents: texts cut from theirs, lists of their sentences and words.
FACTS_SQL = """facts AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 5 = 0 THEN 'project' ELSE 'knowledge' END AS entry_type, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 30) END AS domain,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(text, 31, 20) END AS name, substr(text, 1, 120) AS view, substr(text, 1, 60) AS goal, substr(text, 61, 90) AS phase, CASE WHEN doc_id % 3 = 0 THEN substr(text, 91, 20) END AS blocked,
string_split(text, '.')[1:6] AS insights, string_split(text, '.')[7:9] AS abilities, string_split(text, '.')[2:9] AS decisions, string_split(text, ' ')[1:8] AS tools,
CASE WHEN doc_id % 4 = 0 THEN ['mail', 'chat'] ELSE [] END AS weights, ['c' || doc_id, CASE doc_id % 6 WHEN 0 THEN 'Gmail-1' WHEN 1 THEN 'codex-2' WHEN 2 THEN 'Claude_Code-3' WHEN 3 THEN 'claude-4' WHEN 4 THEN 'GitHub-5' ELSE 'other' END] AS sources,
CASE WHEN doc_id % 10 = 5 THEN ['acme/tools'] ELSE [] END AS repos, CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'compressed' END AS detail_level,
CASE WHEN doc_id % 9 = 0 THEN '' ELSE '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') END AS last_seen, CASE WHEN doc_id % 2 = 0 THEN '2023-12-01' END AS updated FROM documents)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    none = F.array().cast("array<string>")
    source = F.element_at(F.array(*map(F.lit, ("Gmail-1", "codex-2", "Claude_Code-3", "claude-4", "GitHub-5", "other"))), (d % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("entry_id"), F.when(d % 5 == 0, "project").otherwise("knowledge").alias("entry_type"), F.when(d % 7 == 0, "").otherwise(F.substring(text, 1, 30)).alias("domain"),
        F.when(d % 3 == 0, "").otherwise(F.substring(text, 31, 20)).alias("name"), F.substring(text, 1, 120).alias("view"), F.substring(text, 1, 60).alias("goal"), F.substring(text, 61, 90).alias("phase"),
        F.when(d % 3 == 0, F.substring(text, 91, 20)).alias("blocked"), F.slice(F.split(text, r"\."), 1, 6).alias("insights"), F.slice(F.split(text, r"\."), 7, 3).alias("abilities"), F.slice(F.split(text, r"\."), 2, 8).alias("decisions"),
        F.slice(F.split(text, " "), 1, 8).alias("tools"), F.when(d % 4 == 0, F.array(F.lit("mail"), F.lit("chat"))).otherwise(none).alias("weights"), F.array(F.concat(F.lit("c"), d.cast("string")), source).alias("sources"),
        F.when(d % 10 == 5, F.array(F.lit("acme/tools"))).otherwise(none).alias("repos"), F.when(d % 2 == 0, "full").otherwise("compressed").alias("detail_level"),
        F.when(d % 9 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((1 + d % 28).cast("string"), 2, "0"))).alias("last_seen"), F.when(d % 2 == 0, "2023-12-01").alias("updated"),
    )


def columns(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


def _strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def _join(lists: str) -> str:
    return f"array_to_string(list_filter(list_transform({lists}, lambda x: {_strip('x')}), lambda x: x <> ''), ' ')"


@query(f"""WITH {FACTS_SQL} SELECT entry_id, CASE WHEN entry_type = 'project' THEN {_join("[name, goal, phase]")}
ELSE {_join(f"list_concat([domain, view], list_filter(list_transform(insights, lambda y: {_strip('y')}), lambda y: y <> '')[1:3])")} END AS text FROM facts""")
def embedding_texts(spark, sf_dir):
    df = facts(spark, sf_dir)
    return df.select("entry_id", views.embedding_text(columns(df)).alias("text"))


@query(f"""WITH {FACTS_SQL} SELECT entry_id, substr(CASE WHEN entry_type = 'project' THEN {_join("list_concat([goal, phase], decisions[1:2], ['Tech stack: ' || array_to_string(tools[1:6], ', ')])")}
ELSE {_join("list_concat([view], insights[1:3], abilities[1:2])")} END, 1, 600) AS summary FROM facts""")
def classification_summaries(spark, sf_dir):
    df = facts(spark, sf_dir)
    return df.select("entry_id", views.classification_summary(columns(df)).alias("summary"))


@query(f"""WITH {FACTS_SQL}, l AS (SELECT *, lower(sources[1]) AS a, lower(sources[2]) AS b FROM facts) SELECT entry_id, CASE WHEN len(weights) > 0 THEN 'chat, mail' WHEN b LIKE '%mail%' THEN 'email' WHEN b LIKE '%codex%' THEN 'codex transcript'
WHEN b LIKE '%claude%' AND b LIKE '%code%' THEN 'claude_code transcript' WHEN b LIKE '%claude%' THEN 'claude_ai transcript' WHEN b LIKE '%github%' THEN 'github' WHEN len(repos) > 0 THEN 'github-linked' ELSE 'conversation transcript' END AS hint FROM l""")
def source_hints(spark, sf_dir):
    return facts(spark, sf_dir).select("entry_id", views.source_hint(F.col("weights"), F.col("sources"), F.col("repos")).alias("hint"))


@query(f"""WITH {FACTS_SQL}, n AS (SELECT *, CASE WHEN entry_type = 'project' THEN concat_ws(' ', nullif(goal, ''), nullif(phase, ''), nullif(blocked, '')) ELSE coalesce(view, '') END AS told FROM facts)
SELECT entry_id, coalesce(nullif(domain, ''), nullif(name, ''), entry_id::VARCHAR) AS label, coalesce(nullif(last_seen, ''), nullif(updated, ''), '2023-01-01') AS updated_at, told AS narrative, substr(told, 1, 160) AS summary FROM n""")
def entry_labels(spark, sf_dir):
    df = facts(spark, sf_dir)
    told = views.narrative(columns(df))
    label, at = views.entry_label(F.col("domain"), F.col("name"), F.col("entry_id")), views.updated_at(F.col("last_seen"), F.col("updated"), F.lit("2023-01-01"))
    return df.select("entry_id", label.alias("label"), at.alias("updated_at"), told.alias("narrative"), views.summary(told).alias("summary"))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entry_type ORDER BY tier, salience DESC, last_seen DESC, entry_id) AS place FROM entries WHERE NOT archived)
SELECT entry_type, place::INTEGER AS place, entry_id, label, substr(narrative, 1, CASE WHEN entry_type = 'project' THEN 80 ELSE 100 END) AS summary, CASE WHEN entry_type = 'project' THEN substr(narrative, 61, 60) END AS phase,
state, strftime(last_seen, '%Y-%m-%d') AS updated, tier::INTEGER AS tier, context_type, salience, mention_count::BIGINT AS mention_count FROM r WHERE place <= CASE WHEN entry_type = 'project' THEN 50 ELSE 100 END""")
def compact_index(spark, sf_dir):
    return views.compact_index(entries(spark, sf_dir).withColumn("phase", F.substring("narrative", 61, 90)))


@query(f"""WITH {FACTS_SQL} SELECT entry_id, array_to_string((CASE WHEN entry_type = 'project' THEN decisions ELSE insights END)[1:5], '|') AS points, array_to_string(repos, ',') AS related_repos, detail_level = 'full' AS has_full_content FROM facts""")
def context_views(spark, sf_dir):
    df = facts(spark, sf_dir)
    return df.select("entry_id", *views.context_view(columns(df))).withColumns({"points": F.array_join("points", "|"), "related_repos": F.array_join("related_repos", ",")})


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, text, role FROM conversations WHERE text IS NOT NULL),
e AS (SELECT conv_id, turn AS n, text, list_filter(string_split(text, '. '), lambda s: length(s) > 20) AS p FROM t)
SELECT 'ke_' || substr(sha256(conv_id || ':' || n), 1, 12) AS entry_id, substr(text, 1, 40) AS label, 'medium' AS confidence, len(p)::INTEGER AS points, substr(p[1], 1, 200) AS first_evidence,
'm' || n AS source_messages, conv_id::VARCHAR AS sources, substr(text, 1, 80) AS history FROM e WHERE len(p) > 0""")
def converted_entries(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null")
    points = F.filter(F.split("text", r"\. "), lambda s: F.length(s) > 20)
    ids = F.array(F.concat(F.lit("m"), F.col("turn").cast("string")))
    extracted = t.select(
        "conv_id", F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"), F.col("turn").alias("n"), F.substring("text", 1, 40).alias("label"), F.substring("text", 1, 80).alias("view"),
        F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("phase"), F.transform(points, lambda p: F.struct(p.alias("text"), ids.alias("message_ids"), p.alias("snippet"))).alias("points"),
    )
    df = views.converted(extracted)
    return df.select("entry_id", "label", "confidence", F.size("points").alias("points"), "first_evidence", F.array_join("source_messages", ",").alias("source_messages"), F.array_join("sources", ",").alias("sources"), F.array_join("history", "|").alias("history"))


@query("SELECT page_id FROM pages WHERE length(html) >= 150")
def text_gate(spark, sf_dir):
    return views.text_gate(table(spark, sf_dir, "pages"), "html", 150).select("page_id")


@query("SELECT doc_id AS entry_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def skip_existing(spark, sf_dir):
    new, old = (table(spark, sf_dir, t).select(F.col("doc_id").alias("entry_id")) for t in ("documents", "labels"))
    return views.skip_existing(new, old)


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, salience FROM entries WHERE entry_id IN (SELECT user_id FROM events)")
def restricted_cycle(spark, sf_dir):
    return views.restricted(entries(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"))).select("entry_id", "salience")


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), a AS (SELECT count_if(n >= 4) AS k, coalesce(sum(n) FILTER (n >= 4), 0)::BIGINT AS m, count_if(n < 4) AS s FROM c), t AS (SELECT *, m * 500 // 100 AS t FROM a)
SELECT k::BIGINT AS to_process, m::BIGINT AS messages, s::BIGINT AS to_skip, t::BIGINT AS tokens, round(t * 3.0::DOUBLE / 1e6 + t * 0.5::DOUBLE * 15.0::DOUBLE / 1e6, 6) AS cost, round(100.0::DOUBLE * s / (s + k), 4) AS skippable, (k * 2)::BIGINT AS seconds, (k * 3)::BIGINT AS entries FROM t""")
def processing_estimate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    return views.estimate(c.where("message_count >= 4"), c.where("message_count < 4"))


@query(f"""WITH {ENTRIES_SQL}, v AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), p AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
d AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), x AS (SELECT n FROM d ORDER BY day DESC LIMIT 1)
SELECT count_if(entry_type = 'knowledge')::BIGINT AS knowledge, count_if(entry_type = 'project')::BIGINT AS projects, any_value(v.n)::BIGINT AS vectors, any_value(v.d)::INTEGER AS dimensions, any_value(p.n)::BIGINT AS pending,
coalesce((SELECT n FROM x), 0)::BIGINT AS errors_last_day, (SELECT max(o_orderkey) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))::BIGINT AS last_run FROM entries, v, p""")
def store_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    errors = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.to_date("ts").alias("day"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_at"))
    return views.store_stats(entries(spark, sf_dir), table(spark, sf_dir, "embeddings"), docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti"), errors, runs)


UNTYPED_SQL = "u AS (SELECT entry_id, CASE WHEN entry_id % 6 = 0 THEN NULL ELSE context_type END AS context_type, archived FROM entries)"


def untyped(spark, sf_dir):
    return raw_entries(spark, sf_dir).withColumn("context_type", F.when(F.col("entry_id") % 6 != 0, F.col("context_type")))


@query(f"WITH {ENTRIES_SQL}, {UNTYPED_SQL} SELECT count_if(context_type IS NULL AND NOT archived)::BIGINT AS remaining, count_if(context_type IS NULL AND NOT archived) = 0 AS complete FROM u")
def remaining_unclassified(spark, sf_dir):
    return views.remaining_unclassified(untyped(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, {UNTYPED_SQL} SELECT entry_id FROM u WHERE context_type IS NULL")
def pending_ids(spark, sf_dir):
    return views.pending_ids(untyped(spark, sf_dir), True)


@query("""WITH r AS (SELECT 'o' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pushed_at, '1990-01-01' AS updated_at FROM orders UNION ALL SELECT 'u' || event_id, NULL, substr(ts::VARCHAR, 1, 10) FROM events)
SELECT name, coalesce(pushed_at, updated_at) AS active_at FROM r""")
def repo_activity(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 3 != 0, F.substring(F.col("o_orderdate").cast("string"), 1, 10)).alias("pushed_at"), F.lit("1990-01-01").alias("updated_at"))
    b = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("pushed_at"), F.substring(F.col("ts").cast("string"), 1, 10).alias("updated_at"))
    return views.repo_activity_rank([a, b]).select("name", "active_at")


@query("""SELECT source, kind, count(*)::BIGINT AS n FROM (SELECT source, NULL AS kind FROM documents UNION ALL SELECT NULL, role FROM conversations) GROUP BY 1, 2""")
def union_of_sources(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("source")
    b = table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"))
    return views.union_of_sources(a, None, b).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT event_id, user_id AS id, CASE event_id % 3 WHEN 0 THEN '' ELSE 'p' || event_id % 4 END AS phase, CASE WHEN event_id % 5 = 0 THEN 'b' || event_id END AS blocked, 'd' || event_id % 7 AS decision FROM events WHERE user_id IN (SELECT doc_id FROM documents)),
s AS (SELECT *, lag(phase, 1, 'start') OVER (PARTITION BY id ORDER BY event_id) AS was FROM n WHERE phase <> ''),
h AS (SELECT id, array_to_string(list(phase ORDER BY event_id), ',') AS steps, last(phase ORDER BY event_id) AS phase FROM s WHERE phase <> was GROUP BY id),
b AS (SELECT id, max_by(blocked, event_id) FILTER (blocked IS NOT NULL) AS blocked, count(DISTINCT decision) AS n FROM n GROUP BY id)
SELECT doc_id AS entry_id, coalesce(h.phase, 'start') AS phase, 'start' || coalesce(',' || steps, '') AS history, coalesce(b.blocked, 'old') AS blocked, (1 + coalesce(b.n, 0))::INTEGER AS decisions FROM documents LEFT JOIN h ON h.id = doc_id LEFT JOIN b ON b.id = doc_id""")
def merged_projects(spark, sf_dir):
    none = F.array().cast("array<string>")
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("entry_id"), F.substring("text", 1, 20).alias("label"), F.lit("start").alias("phase"), F.lit("old").alias("blocked"), F.array(F.lit("first")).alias("decisions"), F.array(F.lit("start")).alias("history"),
        none.alias("sources"), F.lit("2023").alias("updated_at"))
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    ids = F.concat(F.lit("n"), F.lpad(i.cast("string"), 20, "0"))
    new = e.select(
        ids.alias("entry_id"), F.lit("").alias("label"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("p"), (i % 4).cast("string"))).alias("phase"), F.when(i % 5 == 0, F.concat(F.lit("b"), i.cast("string"))).alias("blocked"),
        F.array(F.concat(F.lit("d"), (i % 7).cast("string"))).alias("decisions"), none.alias("history"), F.array(i.cast("string")).alias("sources"), F.lit("2024").alias("updated_at"))
    found = e.select(ids.alias("new_id"), F.col("user_id").cast("string").alias("old_id")).join(old.select(F.col("entry_id").alias("old_id")), "old_id").select("new_id", "old_id")
    store, _ = views.merged_projects(old, new.join(found.select(F.col("new_id").alias("entry_id")), "entry_id", "left_semi"), found, F.lit(NOW))
    return store.select(F.col("entry_id").cast("long").alias("entry_id"), "phase", F.array_join("history", ",").alias("history"), "blocked", F.size("decisions").alias("decisions"))


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, entry_type, entries.label, state, n_sources::INTEGER AS sources FROM entries JOIN embeddings ON vec_id = entry_id")
def vector_sources(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    return views.with_vector_sources(v, raw_entries(spark, sf_dir)).select("entry_id", "entry_type", "label", "state", F.size("sources").alias("sources"))


@query("""WITH r AS (SELECT event_id AS id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT day, id, place::INTEGER AS place FROM r WHERE place <= 100""")
def error_log(spark, sf_dir):
    return views.error_log(table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"))).select("day", "id", "place")


def _set_sql(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\s+'), lambda x: x <> ''))"


@query(f"""WITH b AS (SELECT conv_id, turn, {_set_sql("text")} AS w FROM conversations), p AS (SELECT conv_id, w FROM b WHERE turn = 0)
SELECT conv_id, turn AS leaf, len(list_intersect(b.w, p.w))::DOUBLE / len(list_distinct(list_concat(b.w, p.w))) AS similarity FROM b JOIN p USING (conv_id) WHERE turn <> 0 AND len(list_distinct(list_concat(b.w, p.w))) > 0
AND len(list_intersect(b.w, p.w))::DOUBLE / len(list_distinct(list_concat(b.w, p.w))) < 0.9""")
def alternate_branches(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("leaf"), (F.col("turn") == 0).alias("is_primary"), "text")
    return views.alternate_branches(b).select("conv_id", "leaf", "similarity")


MAIL_SQL = """m AS (SELECT turn, conv_id, text, CASE WHEN conv_id % 5 = 0 THEN 'noreply@x.org' ELSE 'ann@x.org' END AS sender, CASE WHEN turn % 4 = 3 THEN 'Your receipt from us' ELSE 'about it' END AS subject, CASE WHEN conv_id % 7 = 0 THEN 'no date' ELSE (2015 + conv_id % 10) || '-03-01' END AS date FROM conversations)"""


@query(f"""WITH {MAIL_SQL} SELECT conv_id, turn FROM m WHERE date <> 'no date' AND date >= '2020' AND length(regexp_replace(regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) >= 150 AND sender NOT LIKE 'noreply%'
AND NOT regexp_matches(lower(subject), '{"|".join(mail.SUBJECTS)}') AND NOT regexp_matches(lower(text), '{"|".join(mail.STOPS)}|(^|\\n)>')""")
def mail_gate(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(
        "turn", "conv_id", F.col("text").alias("content"), F.when(F.col("conv_id") % 5 == 0, "noreply@x.org").otherwise("ann@x.org").alias("sender"), F.when(F.col("turn") % 4 == 3, "Your receipt from us").otherwise("about it").alias("subject"),
        F.when(F.col("conv_id") % 7 == 0, "no date").otherwise(F.concat((2015 + F.col("conv_id") % 10).cast("string"), F.lit("-03-01"))).alias("date"))
    return mail.mail_gate(m).select("conv_id", "turn")


@query("""WITH c AS (SELECT 'r' || source AS repo, doc_id, substr(text, 1, 200) AS message, DATE '2024-01-01' + (doc_id % 300)::INTEGER AS date FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date DESC, doc_id) AS n FROM c WHERE length(message) > 50 AND NOT regexp_matches(lower(message), '^(merge|update|fix typo|bump)'))
SELECT repo, string_agg('[' || date || '] ' || message, chr(10) ORDER BY n) AS log FROM r WHERE n <= 30 GROUP BY repo""")
def commit_logs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return mail.substantive_commits(d.select(F.concat(F.lit("r"), F.col("source")).alias("repo"), F.col("doc_id").alias("sha"), F.substring("text", 1, 200).alias("message"), day.alias("date")))


@query("""WITH u AS (SELECT page_id, 'owner' || page_id % 9 AS owner, 'name' || page_id AS repo FROM pages) SELECT page_id, owner, repo FROM u""")
def git_remotes(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    path = F.concat(F.lit("owner"), (i % 9).cast("string"), F.lit("/name"), i.cast("string"))
    url = F.when(i % 2 == 0, F.concat(F.lit("git@github.com:"), path, F.lit(".git"))).otherwise(F.concat(F.lit("https://github.com/"), path))
    return p.select("page_id", parse.git_remote(url).alias("r")).select("page_id", "r.*")


@query("""SELECT l.doc_id AS entry_id, CASE WHEN l.quality = 1 THEN 'a,b' ELSE 'a' END AS linked, CASE WHEN l.quality = 1 THEN '' ELSE 'a' END AS cut FROM labels l""")
def relation_links(spark, sf_dir):
    one = lambda k: F.struct(F.lit(k).alias("knowledge_id"), F.lit("related").alias("relationship"))
    df = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), F.array(one("a")).alias("links"), F.when(F.col("quality") == 1, "b").otherwise("a").alias("other"), F.when(F.col("quality") == 1, "a").otherwise("z").alias("less"))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["knowledge_id"]), ",")
    return df.select("entry_id", names(mutate.with_link(F.col("links"), F.col("other"), "related")).alias("linked"), names(mutate.without_links(F.col("links"), F.col("less"))).alias("cut"))


@query(f"""SELECT doc_id AS entry_id, TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 30)::INTEGER) AS date, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS delta FROM documents WHERE doc_id % 30 >= 1 ORDER BY date DESC, entry_id LIMIT 10""")
def recent_evolutions(spark, sf_dir):
    day = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), day.alias("date"), F.col("text").alias("delta"))
    return lifecycle.recent_evolutions(e, F.lit(NOW).cast("timestamp")).select("entry_id", "date", "delta")


@query("""WITH r AS (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, id FROM r WHERE n <= 20""")
def trimmed_logs(spark, sf_dir):
    return upkeep.trimmed_log(table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("id")), "user_id", 20).select("user_id", "id")


@query(f"""{PAIRS_SQL}, g AS (SELECT fp FROM f WHERE fp IS NOT NULL GROUP BY fp HAVING count(*) > 1), s AS (SELECT fp, bool_or(reason IS NOT NULL) AS against, bool_and(compatible) AS agree FROM pairs GROUP BY fp),
m AS (SELECT g.fp FROM g LEFT JOIN s USING (fp) WHERE NOT coalesce(against, FALSE) AND coalesce(agree, TRUE)),
x AS (SELECT f.fp, e.*, ['c' || e.entry_id, 'c' || (e.entry_id + 1), 'c' || (e.entry_id + 2)][1:e.n_sources] AS sources, string_split(e.narrative, '. ')[1:3] AS insights,
  row_number() OVER (PARTITION BY f.fp ORDER BY e.tier, e.mention_count DESC, e.access_count DESC, e.salience DESC, e.last_seen DESC, e.entry_id) AS rank FROM f JOIN m USING (fp) JOIN entries e USING (entry_id) WHERE NOT e.archived),
k AS (SELECT fp, min_by(entry_id, rank) AS id, count(*) AS n, sum(access_count) AS a FROM x GROUP BY fp HAVING count(*) > 1),
l AS (SELECT fp, v, min(rank * 1000 + pl) AS pl FROM (SELECT fp, rank, unnest(sources) AS v, generate_subscripts(sources, 1) AS pl FROM x) GROUP BY fp, v),
i AS (SELECT fp, v, min(rank * 1000 + pl) AS pl FROM (SELECT fp, rank, unnest(insights) AS v, generate_subscripts(insights, 1) AS pl FROM x) GROUP BY fp, v),
ls AS (SELECT fp, list(v ORDER BY pl) AS v FROM l GROUP BY fp), li AS (SELECT fp, list(v ORDER BY pl) AS v FROM i GROUP BY fp)
SELECT e.entry_id, CASE WHEN k.id IS NOT NULL THEN len(ls.v) ELSE e.mention_count END::BIGINT AS mention_count, CASE WHEN k.id IS NOT NULL THEN k.a WHEN x.fp IS NOT NULL AND kx.id IS NOT NULL THEN 0 ELSE e.access_count END::BIGINT AS access_count,
array_to_string(coalesce(ls.v, ['c' || e.entry_id, 'c' || (e.entry_id + 1), 'c' || (e.entry_id + 2)][1:e.n_sources]), ',') AS sources, array_to_string(coalesce(li.v, string_split(e.narrative, '. ')[1:3]), '|') AS insights,
(e.archived OR (kx.id IS NOT NULL AND k.id IS NULL)) AS archived FROM entries e LEFT JOIN k ON k.id = e.entry_id LEFT JOIN ls ON ls.fp = k.fp LEFT JOIN li ON li.fp = k.fp LEFT JOIN x ON x.entry_id = e.entry_id LEFT JOIN k kx ON kx.fp = x.fp""")
def consolidated_entries(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("insights", F.slice(F.split("narrative", r"\. "), 1, 3))
    plan = replay.plans(raw_entries(spark, sf_dir)).where("plan = 'merge'")
    now = F.lit(NOW).cast("timestamp")
    after, gone = replay.consolidated(e, plan.select("fp"), "r1", now)
    after, _ = lifecycle.archived(after, gone, "r1", now, "merged duplicate")
    return after.select("entry_id", F.col("mention_count").cast("long").alias("mention_count"), "access_count", F.array_join("sources", ",").alias("sources"), F.array_join("insights", "|").alias("insights"), "archived")


# ---------------------------------------------------------------- consolidation in order, whole budget

CHAIN_SQL = f"""WITH {{E}}, d AS (SELECT entry_id, entry_type, archived, label, n_sources, mention_count, entry_id // 4 AS g, entry_id % 4 AS i FROM base),
w AS (SELECT g, count_if(i = 0) > 0 AS h0, count_if(i = 1) > 0 AS h1, count_if(i = 2) > 0 AS h2, count_if(i = 3) > 0 AS h3, coalesce(bool_or(archived) FILTER (i = 0), FALSE) AS x0, coalesce(bool_or(archived) FILTER (i = 1), FALSE) AS x1,
  coalesce(bool_or(archived) FILTER (i = 2), FALSE) AS x2, coalesce(bool_or(archived) FILTER (i = 3), FALSE) AS x3, count(DISTINCT entry_type) FILTER (i < 3) AS k1, count(DISTINCT entry_type) FILTER (i IN (0, 3)) AS k2 FROM d GROUP BY g),
u AS (SELECT *, g % 2 = 0 AND h0 AND NOT x0 AS up, (g % 2 = 0)::INT AS want FROM w),
a AS (SELECT *, CASE WHEN k1 > 1 THEN 'mixed_entry_types' WHEN NOT (h0 AND h1 AND h2) THEN 'not_found' WHEN x0 OR x1 OR x2 THEN 'archived' WHEN up::INT <> want OR g % 7 = 0 THEN 'conflict' ELSE 'ok' END AS s1 FROM u),
b AS (SELECT *, h1 AND NOT x1 AND s1 <> 'ok' AS late, CASE WHEN k2 > 1 THEN 'mixed_entry_types' WHEN NOT (h3 AND h0) THEN 'not_found' WHEN x3 OR x0 THEN 'archived' WHEN up::INT + (s1 = 'ok')::INT <> want + 1 THEN 'conflict' ELSE 'ok' END AS s2 FROM a)"""


def _chain(spark, sf_dir) -> dict[str, DataFrame]:
    """Documents by four: an update of the first, its consolidation with the next two, an insight on the second, and then
    the first goes into the fourth. Expected revisions are right but for every seventh group and what happens before."""
    d, g = F.col("entry_id"), F.floor(F.col("entry_id") / 4)
    base = raw_entries(spark, sf_dir)
    e = base.select("entry_id", "entry_type", F.lit(0).alias("revision"), "archived", F.col("narrative").alias("view"), "confidence", "state", "context_type", F.array("label").alias("insights"), "sources", "mention_count", "access_count", F.array(F.struct((d + 1).alias("knowledge_id"), F.lit("contradicts").alias("relationship"))).alias("links"))
    at = lambda h: F.lit(f"2024-01-01 0{h}:00:00").cast("timestamp")
    none = F.lit(None).cast("string")
    move = lambda name, kind, h: [F.concat(F.lit(name), d.cast("string")).alias("mutation_id"), at(h).alias("ts"), F.lit(kind).alias("kind"), "entry_id", F.lit(None).cast("int").alias("expected_revision"), (F.lit("updated") if kind == "update" else none).alias("view"), none.alias("confidence"), none.alias("state"), none.alias("context_type"), (F.lit("a later insight") if kind == "insight" else none).alias("insight")]
    moves = base.where((d % 4 == 0) & (g % 2 == 0)).select(*move("u", "update", 1)).unionByName(base.where(d % 4 == 1).select(*move("i", "insight", 3)))
    groups = base.select((g * 4).alias("k")).distinct()
    want = F.when(F.floor(F.col("k") / 4) % 2 == 0, 1).otherwise(0)
    k = F.col("k")
    first = groups.select(F.concat(F.lit("a"), k.cast("string")).alias("mutation_id"), at(2).alias("ts"), k.alias("keep_id"), F.array(k + 1, k + 2).alias("archive_ids"), F.create_map(k, F.when(F.floor(k / 4) % 7 == 0, 5).otherwise(want), k + 1, F.lit(0), k + 2, F.lit(0)).alias("expected_revisions"))
    second = groups.select(F.concat(F.lit("b"), k.cast("string")).alias("mutation_id"), at(4).alias("ts"), (k + 3).alias("keep_id"), F.array(k).alias("archive_ids"), F.create_map(k + 3, F.lit(0), k, want + 1).alias("expected_revisions"))
    return consolidate.consolidate_in_order(e, moves, first.unionByName(second))


@query(CHAIN_SQL.replace("{E}", ENTRIES_SQL) + """, m(p) AS (VALUES (1), (2)) SELECT CASE WHEN p = 1 THEN 'a' ELSE 'b' END || (g * 4) AS mutation_id, CASE WHEN p = 1 THEN g * 4 ELSE g * 4 + 3 END AS keep_id, CASE WHEN p = 1 THEN s1 ELSE s2 END AS status FROM b, m""")
def consolidation_results(spark, sf_dir):
    return _chain(spark, sf_dir)["consolidations"].select("mutation_id", "keep_id", "status")


IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(CHAIN_SQL.replace("{E}", ENTRIES_SQL) + f""", c AS (SELECT d.*, list_transform(range(0, n_sources), lambda j: 'c' || (entry_id + j)) AS src, [label] AS ins FROM d),
q AS (SELECT c.*, b.* EXCLUDE (g), max(CASE WHEN c.i = 0 THEN c.src END) OVER w AS s_0, max(CASE WHEN c.i = 1 THEN c.src END) OVER w AS s_1, max(CASE WHEN c.i = 2 THEN c.src END) OVER w AS s_2,
  max(CASE WHEN c.i = 0 THEN c.label END) OVER w AS l_0, max(CASE WHEN c.i = 1 THEN c.label END) OVER w AS l_1, max(CASE WHEN c.i = 2 THEN c.label END) OVER w AS l_2 FROM c JOIN b USING (g) WINDOW w AS (PARTITION BY c.g)),
t AS (SELECT *, CASE WHEN s1 = 'ok' THEN {IN_ORDER.format("(s_0 || s_1 || s_2)")} ELSE s_0 END AS t_0, CASE WHEN s1 = 'ok' THEN {IN_ORDER.format("[l_0, l_1, l_2]")} ELSE [l_0] END AS u_0,
  CASE WHEN s1 <> 'ok' THEN [(g * 4 + 1) || ' contradicts'] WHEN entry_type = 'project' THEN [(g * 4 + 1) || ' contradicts', (g * 4 + 2) || ' contradicts', (g * 4 + 3) || ' contradicts']
    ELSE [(g * 4 + 3) || ' contradicts', (g * 4 + 1) || ' supersedes', (g * 4 + 2) || ' supersedes'] END AS v_0 FROM q)
SELECT entry_id, CASE i WHEN 0 THEN up::INT + (s1 = 'ok')::INT + (s2 = 'ok')::INT WHEN 1 THEN (s1 = 'ok')::INT + late::INT WHEN 2 THEN (s1 = 'ok')::INT ELSE (s2 = 'ok')::INT END AS revision,
  archived OR (i IN (1, 2) AND s1 = 'ok') OR (i = 0 AND s2 = 'ok') AS archived,
  array_to_string(CASE WHEN i = 0 THEN t_0 WHEN i = 3 AND s2 = 'ok' THEN {IN_ORDER.format("(src || t_0)")} ELSE src END, ',') AS sources,
  array_to_string(CASE WHEN i = 0 THEN u_0 WHEN i = 1 AND late THEN [label, 'a later insight'] WHEN i = 3 AND s2 = 'ok' THEN {IN_ORDER.format("([label] || u_0)")} ELSE [label] END, '|') AS insights,
  array_to_string(CASE WHEN i = 0 THEN v_0 WHEN i = 3 AND s2 = 'ok' THEN list_filter([(entry_id + 1) || ' contradicts'] || v_0, lambda x: entry_type = 'project' OR x <> (g * 4) || ' contradicts') || CASE WHEN entry_type = 'project' THEN [] ELSE [(g * 4) || ' supersedes'] END
    ELSE [(entry_id + 1) || ' contradicts'] END, ',') AS links FROM t""")
def consolidated_in_order(spark, sf_dir):
    after = _chain(spark, sf_dir)["entries"]
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["knowledge_id"].cast("string"), x["relationship"])), ",")
    return after.select("entry_id", "revision", "archived", F.array_join("sources", ",").alias("sources"), F.array_join("insights", "|").alias("insights"), links.alias("links"))


BUDGETED_SQL = """WITH RECURSIVE {E}, r AS (SELECT CASE WHEN entry_type = 'project' THEN 'project' ELSE 'topic' END AS kind, entry_id, round(length(narrative) / 4.0)::BIGINT AS tokens, salience, tier FROM entries WHERE NOT archived
  UNION ALL SELECT 'evolution', entry_id, 15, 0, entry_id FROM entries WHERE state = 'contested'),
s AS (SELECT kind, entry_id, tokens, CASE WHEN kind = 'evolution' THEN tokens ELSE least(tokens, 12) END AS short, row_number() OVER (PARTITION BY kind ORDER BY tier, salience DESC, entry_id) AS place FROM r),
n AS (SELECT count_if(kind = 'topic')::BIGINT AS nt, count_if(kind = 'project')::BIGINT AS np, count_if(kind = 'evolution')::BIGINT AS ne FROM s),
t AS (SELECT 0 AS i, nt AS size FROM n UNION ALL SELECT i + 1, floor(size * 0.8)::BIGINT FROM t WHERE size > 100), p AS (SELECT 0 AS i, np AS size FROM n UNION ALL SELECT i + 1, floor(size * 0.8)::BIGINT FROM p WHERE size > 50),
st AS (SELECT i AS step, size AS a, np AS b, ne AS c FROM t, n UNION ALL SELECT 1000 + p.i, (SELECT min(size) FROM t), p.size, ne FROM p, n WHERE p.i > 0 UNION ALL SELECT 2000, (SELECT min(size) FROM t), (SELECT min(size) FROM p), 10 FROM n WHERE ne > 10),
cost AS (SELECT st.step, a, b, c, sum(tokens) AS used, sum(short) AS cut FROM st JOIN s ON (kind = 'topic' AND place <= a) OR (kind = 'project' AND place <= b) OR (kind = 'evolution' AND place <= c) GROUP BY ALL),
f AS (SELECT coalesce(min(step) FILTER (used <= {B}), max(step)) AS step, count_if(used <= {B}) = 0 AS shortened FROM cost)
SELECT kind, place::BIGINT AS place, entry_id, shortened, shortened AND cut > {B} AS over_budget FROM s, f JOIN cost USING (step) WHERE (kind = 'topic' AND place <= a) OR (kind = 'project' AND place <= b) OR (kind = 'evolution' AND place <= c)"""


def _index_rows(spark, sf_dir) -> DataFrame:
    e = entries(spark, sf_dir)
    tokens = parse.token_estimate(F.col("narrative"))
    part = lambda kind, df, order: numbered(df, order).withColumns({"kind": F.lit(kind)}).select("kind", "place", "entry_id", "tokens", "short_tokens")
    live = e.where("not archived").select("entry_id", "entry_type", "tier", "salience", tokens.alias("tokens"), F.least(tokens, F.lit(12)).alias("short_tokens"))
    order = [F.col("tier"), F.col("salience").desc(), F.col("entry_id")]
    changed = e.where("state = 'contested'").select("entry_id", F.lit(15).cast("long").alias("tokens"), F.lit(15).cast("long").alias("short_tokens"))
    return part("topic", live.where("entry_type <> 'project'"), order).unionByName(part("project", live.where("entry_type = 'project'"), order)).unionByName(part("evolution", changed, [F.col("entry_id")]))


@query(BUDGETED_SQL.replace("{E}", ENTRIES_SQL).replace("{B}", "150000"))
def budgeted_index(spark, sf_dir):
    return lifecycle.budgeted_index(_index_rows(spark, sf_dir), 150_000).select("kind", "place", "entry_id", "shortened", "over_budget")


@query(BUDGETED_SQL.replace("{E}", ENTRIES_SQL).replace("{B}", "1500"))
def over_budget_index(spark, sf_dir):
    return lifecycle.budgeted_index(_index_rows(spark, sf_dir), 1500).select("kind", "place", "entry_id", "shortened", "over_budget")
