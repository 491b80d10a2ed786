"""Registered queries of the store's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake import policy as P
from memlake.functions import scoring as S
from memlake.operators import filters, lifecycle, mail, merge, mutate, parse, replay, search, upkeep
from memlake.plans.tables import numbered
from memlake.streaming import rate_windows

NOW = "2024-01-31 00:00:00"
CONFIDENCES = ("high", "medium", "low", "odd")
SAID = {5: " I decided to use it.", 7: " There is an error in the build.", 9: " In summary, it holds.", 11: " See github.com/acme/tools for the code."}

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- entries over documents and events

ACCESS_SQL = "access AS (SELECT user_id AS entry_id, count(*) AS access_count, max(ts)::TIMESTAMP AS last_accessed FROM events GROUP BY user_id)"
ENTRIES_SQL = f"""{ACCESS_SQL},
base AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 5 = 0 THEN 'project' ELSE 'knowledge' END AS entry_type, substr(text, 1, 60) AS label, text AS narrative,
  CASE doc_id % 7 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(P.CONTEXT_TYPES))} END AS context_type,
  CASE doc_id % 4 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONFIDENCES))} END AS confidence,
  1 + doc_id % 25 AS mention_count, TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 30)::INTEGER) AS last_seen,
  CASE WHEN doc_id % 11 = 0 THEN 'contested' ELSE 'active' END AS state, doc_id % 13 = 0 AS archived, 1 + doc_id % 3 AS n_sources FROM documents),
entries AS (SELECT base.*, coalesce(access.access_count, 0) AS access_count, access.last_accessed,
  CASE WHEN context_type IN ('professional_identity', 'stated_preference', 'explicit_save', 'active_project') THEN 1 WHEN context_type = 'recurring_pattern' THEN 2 ELSE 3 END AS tier,
  floor(least(1.0, (CASE confidence WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.4 ELSE 0.7 END)::DOUBLE
    * CASE WHEN context_type IN ('professional_identity', 'stated_preference', 'explicit_save', 'active_project') THEN 1.0::DOUBLE ELSE
      pow(0.5::DOUBLE, greatest(0.0, epoch(TIMESTAMP '{NOW}' - last_seen) / 86400.0)::DOUBLE / CASE context_type WHEN 'recurring_pattern' THEN 90.0 WHEN 'task_query' THEN 30.0 ELSE 14.0 END) END
    * (CASE context_type WHEN 'active_project' THEN 0.95 WHEN 'recurring_pattern' THEN 0.8 WHEN 'task_query' THEN 0.2 WHEN 'passing_reference' THEN 0.05 ELSE 1.0 END)::DOUBLE
    * least(1.0, ln(1.0::DOUBLE + mention_count) / ln(21.0::DOUBLE))
    + CASE WHEN last_accessed IS NULL THEN 0.0::DOUBLE ELSE 0.15 * pow(0.5::DOUBLE, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400e6)::DOUBLE / 60.0) END) * 10000 + 0.5) / 10000 AS salience
  FROM base LEFT JOIN access USING (entry_id))"""


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access events: a user's events are retrievals of the entry of that id."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entry_id")).agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").cast("timestamp").alias("last_accessed"))


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (d % len(names) + 1).cast("int"))
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((d % 30).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("entry_id"), F.when(d % 5 == 0, "project").otherwise("knowledge").alias("entry_type"), F.substring("text", 1, 60).alias("label"), F.col("text").alias("narrative"),
        of(P.CONTEXT_TYPES).alias("context_type"), of(CONFIDENCES).alias("confidence"), (1 + d % 25).alias("mention_count"), seen.alias("last_seen"), seen.alias("updated_at"),
        F.when(d % 11 == 0, "contested").otherwise("active").alias("state"), (d % 13 == 0).alias("archived"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed"),
        F.lit(None).cast("int").alias("tier"), F.transform(F.sequence(F.lit(0).cast("long"), d % 3), lambda i: F.concat(F.lit("c"), (d + i).cast("string"))).alias("sources"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.with_scores(lifecycle.with_access(raw_entries(spark, sf_dir), access(spark, sf_dir)), F.lit(NOW).cast("timestamp"))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entry_type ORDER BY tier, salience DESC, last_seen DESC, entry_id) AS place FROM entries WHERE NOT archived)
SELECT entry_id, entry_type, place::INTEGER AS place, tier::INTEGER AS tier, salience, CASE WHEN length(narrative) > 80 THEN substr(narrative, 1, 77) || '...' ELSE narrative END AS summary, state, label
FROM r WHERE place <= CASE WHEN entry_type = 'project' THEN 50 ELSE 100 END""")
def salience_ranked_index(spark, sf_dir):
    return lifecycle.thin_index(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, tier::INTEGER AS tier, salience, access_count::BIGINT AS access_count FROM entries")
def salience_scores(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", "tier", "salience", "access_count")


@query(f"""WITH {ENTRIES_SQL} SELECT entry_type, count(*)::BIGINT AS entries, count_if(NOT archived AND tier = 1)::BIGINT AS tier_1, count_if(NOT archived AND tier = 2)::BIGINT AS tier_2,
count_if(NOT archived AND tier = 3)::BIGINT AS tier_3, count_if(archived)::BIGINT AS archived, count_if(state = 'contested')::BIGINT AS contested FROM entries GROUP BY 1""")
def tier_counts(spark, sf_dir):
    return lifecycle.counts(entries(spark, sf_dir))


BUCKET_SQL = "CASE WHEN tier = 1 OR salience >= 0.35 THEN 'stable' WHEN salience >= 0.1 THEN 'active' WHEN salience >= 0.05 THEN 'weak' ELSE 'decay_candidate' END"


@query(f"WITH {ENTRIES_SQL} SELECT {BUCKET_SQL} AS bucket, count(*)::BIGINT AS entries FROM entries WHERE NOT archived GROUP BY 1")
def bucket_counts(spark, sf_dir):
    df = entries(spark, sf_dir).where("not archived")
    return df.groupBy(lifecycle.bucket(F.col("context_type"), F.col("tier"), F.col("salience")).alias("bucket")).agg(F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {ENTRIES_SQL} SELECT entry_id, salience FROM entries WHERE NOT archived AND context_type IN ('task_query', 'passing_reference') AND mention_count = 1 AND access_count = 0 AND salience < 0.05""")
def archive_candidates(spark, sf_dir):
    return lifecycle.archive_candidates(entries(spark, sf_dir).where("not archived")).select("entry_id", "salience")


@query(f"""WITH {ENTRIES_SQL} SELECT entry_id, mention_count::BIGINT AS mention_count, access_count::BIGINT AS access_count FROM entries WHERE NOT archived AND context_type = 'task_query' AND mention_count >= 3 AND (access_count > 0 OR n_sources > 1)""")
def promotion_candidates(spark, sf_dir):
    return lifecycle.promotion_candidates(entries(spark, sf_dir).where("not archived")).select("entry_id", "mention_count", "access_count")


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, access_count::BIGINT AS access_count, last_accessed FROM entries WHERE access_count > 0")
def access_overlay(spark, sf_dir):
    return lifecycle.with_access(raw_entries(spark, sf_dir), access(spark, sf_dir)).where("access_count > 0").select("entry_id", "access_count", "last_accessed")


@query(f"""WITH {ENTRIES_SQL} SELECT entry_id, CASE WHEN context_type = 'task_query' AND access_count >= 3 THEN 'recurring_pattern' ELSE context_type END AS context_type,
context_type = 'task_query' AND access_count >= 3 AS promoted, access_count::BIGINT AS access_count FROM entries""")
def reconsolidate_promotions(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"))
    df = raw_entries(spark, sf_dir).withColumn("notes", F.array().cast("array<string>"))
    return lifecycle.reconsolidated(df, hits, F.lit(NOW).cast("timestamp")).select("entry_id", "context_type", "promoted", "access_count")


@query(f"""WITH RECURSIVE {ENTRIES_SQL}, s AS (SELECT entry_id, round(length(narrative) / 4.0)::BIGINT AS tokens, row_number() OVER (ORDER BY tier, salience DESC, entry_id) AS place FROM entries WHERE NOT archived),
n AS (SELECT count(*)::BIGINT AS size FROM s UNION ALL SELECT floor(size * 0.8)::BIGINT FROM n WHERE size > 100), u AS (SELECT place, sum(tokens) OVER (ORDER BY place) AS used FROM s),
f AS (SELECT n.size, coalesce(u.used, 0) AS used FROM n LEFT JOIN u ON n.size = u.place), p AS (SELECT coalesce(max(size) FILTER (used <= 200000), min(size)) AS size, count(*) FILTER (used <= 200000) = 0 AS over_budget FROM f)
SELECT place::BIGINT AS place, entry_id, tokens, over_budget FROM s, p WHERE place <= size""")
def index_budget_trim(spark, sf_dir):
    e = entries(spark, sf_dir).where("not archived").select("entry_id", "tier", "salience", parse.token_estimate(F.col("narrative")).alias("tokens"))
    e = numbered(e, [F.col("tier"), F.col("salience").desc(), F.col("entry_id")])
    return lifecycle.budgeted(e.select("place", "entry_id", "tokens"), 200_000)


# ---------------------------------------------------------------- replay

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
FP_SQL = f"f AS (SELECT *, CASE WHEN length({NORM.format('label')}) >= 6 THEN entry_type || ':' || {NORM.format('label')} END AS fp, {NORM.format('narrative')} AS nn, confidence = 'low' AS low FROM base)"
OPPOSING_SQL = "CASE " + " ".join(f"WHEN (a.nn LIKE '%{p}%' AND b.nn LIKE '%{n}%') OR (a.nn LIKE '%{n}%' AND b.nn LIKE '%{p}%') THEN 'opposing markers ({p} vs {n})'" for p, n in P.OPPOSING) + " END"
PAIRS_SQL = f"""WITH {ENTRIES_SQL}, {FP_SQL}, v AS (SELECT fp, entry_type, nn, low, min(entry_id) AS id, list_distinct(list_filter(string_split(nn, ' '), lambda x: x <> '')) AS words FROM f WHERE fp IS NOT NULL GROUP BY fp, entry_type, nn, low),
p AS (SELECT a.fp, a.id AS a_id, b.id AS b_id, a.entry_type = 'project' AS project, a.nn = '' OR b.nn = '' AS blank, a.low OR b.low AS low,
  CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(a.words || b.words)) ELSE 0.0 END AS near,
  {OPPOSING_SQL} AS opp, contains(a.nn, b.nn) OR contains(b.nn, a.nn) AS within FROM v a JOIN v b ON a.fp = b.fp AND (a.nn < b.nn OR (a.nn = b.nn AND a.low < b.low))),
q AS (SELECT fp, a_id, b_id, near, CASE WHEN NOT project AND NOT blank THEN opp END AS against, project, blank, low, within FROM p),
pairs AS (SELECT fp, a_id, b_id, near, project OR blank OR (against IS NULL AND (near >= 0.3 OR within)) AS compatible,
  coalesce(against, CASE WHEN NOT project AND NOT blank AND NOT low AND near <= 0.12 THEN 'same topic has materially different views (similarity=' || printf('%.2f', near) || ')' END) AS reason FROM q)"""


@query(f"{PAIRS_SQL} SELECT fp, a_id, b_id, round(near, 6) AS near, compatible, reason FROM pairs")
def view_pairs(spark, sf_dir):
    return replay.view_pairs(raw_entries(spark, sf_dir)).withColumn("near", S.half_up(F.col("near"), 6))


@query(f"""{PAIRS_SQL}, g AS (SELECT fp, count(*) AS n FROM f WHERE fp IS NOT NULL GROUP BY fp HAVING count(*) > 1), s AS (SELECT fp, bool_or(reason IS NOT NULL) AS against, bool_and(compatible) AS agree FROM pairs GROUP BY fp)
SELECT fp, n::BIGINT AS n_entries, CASE WHEN coalesce(against, FALSE) THEN 'contest' WHEN coalesce(agree, TRUE) THEN 'merge' ELSE 'none' END AS plan FROM g LEFT JOIN s USING (fp)""")
def duplicate_plans(spark, sf_dir):
    return replay.plans(raw_entries(spark, sf_dir)).select("fp", "n_entries", "plan")


@query(f"""{PAIRS_SQL}, x AS (SELECT a_id AS entry_id, b_id AS other, reason FROM pairs WHERE reason IS NOT NULL UNION ALL SELECT b_id, a_id, reason FROM pairs WHERE reason IS NOT NULL)
SELECT entry_id, array_to_string(list_sort(list_distinct(list(reason))), '; ') AS reasons, array_to_string(list_sort(list_distinct(list(other))), ',') AS conflicts, 'contested' AS state FROM x GROUP BY entry_id""")
def contradiction_plans(spark, sf_dir):
    e = raw_entries(spark, sf_dir)
    return replay.contested(e, replay.contradictions(e)).select("entry_id", F.array_join("reasons", "; ").alias("reasons"), F.array_join("conflicts", ",").alias("conflicts"), "state")


@query(f"""WITH {ENTRIES_SQL}, f AS (SELECT *, entry_type || ':' || {NORM.format('label')} AS fp FROM entries WHERE length({NORM.format('label')}) >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY tier, mention_count DESC, access_count DESC, salience DESC, last_seen DESC, entry_id) AS rank FROM f)
SELECT fp, min_by(entry_id, rank) AS entry_id, sum(access_count)::BIGINT AS access_count, min(last_seen) AS first_seen, max(last_seen) AS last_seen, count(*)::BIGINT AS merged_from FROM r GROUP BY fp HAVING count(*) > 1""")
def canonical_merge(spark, sf_dir):
    e = replay.fingerprints(entries(spark, sf_dir)).where("fp is not null").withColumns({"first_seen": F.col("last_seen"), "goal": F.col("label")})
    m = replay.merged(replay.canonical_rank(e)).where("merged_from > 1")
    return m.select("fp", "entry_id", "access_count", "first_seen", "last_seen", "merged_from")


# ---------------------------------------------------------------- conversations

TALK_SQL = "talk AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN turn = 1 THEN CASE " + " ".join(f"WHEN conv_id % {k} = 0 THEN '{v}'" for k, v in SAID.items()) + " ELSE '' END ELSE '' END AS text FROM conversations)"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with phrases put in by id, for their prose has none."""
    more = F.lit("")
    for k, v in reversed(SAID.items()):
        more = F.when(F.col("conv_id") % k == 0, v).otherwise(more)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") == 1, more).otherwise(F.lit(""))).alias("text"))


def _re(words) -> str:
    return filters.phrase(words).replace("'", "''")


SCORES_SQL = f"""WITH {TALK_SQL}, m AS (SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, lower(string_agg(text, ' ' ORDER BY turn)) AS t,
  lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')) AS u, count_if(role = 'user') AS nu, count_if(role = 'assistant') AS na FROM talk GROUP BY conv_id),
x AS (SELECT *, lower(array_to_string(texts[greatest(n - 2, 1):], ' ')) AS l, roles[greatest(n - 2, 1):] AS lr FROM m),
s AS (SELECT conv_id, n, least(nu, na) AS exchanges, contains(t, '```') AS has_code, regexp_matches(t, '{_re(filters.DECISION)}') AS decided, regexp_matches(u, '{_re(filters.LEARNING)}') AS learned,
  regexp_matches(t, '{_re(filters.PROJECT)}') AS project, regexp_matches(t, '{filters.REPOSITORY}') AS repository, regexp_matches(l, '{_re(filters.CONCLUSION)}') AS concluded,
  regexp_matches(t, '{_re(filters.TROUBLE)}') AND NOT regexp_matches(t, '{_re(filters.DECISION)}') AND NOT regexp_matches(t, '{_re(filters.CONCLUSION)}') AS trouble,
  regexp_matches(t, '{_re(filters.META)}') AND len(regexp_extract_all(t, '{_re(filters.AI_WORDS)}')) > 3 AND n < 6 AS meta, n >= 3 AND len(list_filter(lr, lambda r: r IS DISTINCT FROM 'assistant')) = 0 AS abandoned FROM x),
scores AS (SELECT *, (least(exchanges // 5, 3) + 3 * has_code::INT + 3 * decided::INT + 2 * learned::INT + 2 * project::INT + 2 * repository::INT + 2 * concluded::INT - 2 * trouble::INT - 3 * meta::INT - 2 * abandoned::INT)::INTEGER AS value_score FROM s)"""


@query(f"""{SCORES_SQL} SELECT conv_id, value_score, CASE WHEN value_score >= 3 THEN 'keep' ELSE 'skip' END AS decision,
CASE WHEN value_score >= 3 THEN NULL WHEN trouble THEN 'pure_troubleshooting' WHEN meta THEN 'meta_about_ai' WHEN abandoned THEN 'abandoned_thread' WHEN value_score <= 0 THEN 'no_value_signals' ELSE 'below_threshold' END AS skip_reason FROM scores""")
def value_score_conversations(spark, sf_dir):
    return filters.scored(talk(spark, sf_dir)).select("conv_id", "value_score", "decision", "skip_reason")


@query(f"{SCORES_SQL} SELECT value_score, count(*)::BIGINT AS conversations FROM scores GROUP BY 1")
def score_distribution(spark, sf_dir):
    return filters.score_distribution(filters.scored(talk(spark, sf_dir)))


@query(f"{SCORES_SQL} SELECT conv_id, abandoned FROM scores")
def abandoned_threads(spark, sf_dir):
    return filters.scored(talk(spark, sf_dir)).select("conv_id", "abandoned")


@query("""SELECT conv_id, count(*)::BIGINT AS message_count, count_if(role = 'user')::BIGINT AS user_messages, count_if(role = 'assistant')::BIGINT AS assistant_messages,
bool_or(contains(coalesce(text, ''), '```')) AS has_code, coalesce(sum(length(text)), 0)::BIGINT AS total_length FROM conversations GROUP BY 1""")
def conversation_stats(spark, sf_dir):
    return parse.conversation_stats(table(spark, sf_dir, "conversations"))


FENCE_SQL = "fenced AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || '```py' || chr(10) || ' x = ' || turn || chr(10) || '```' ELSE '' END AS text FROM conversations)"


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("\n```py\n x = "), F.col("turn").cast("string"), F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, code).otherwise("")).alias("text"))


@query(f"""WITH {FENCE_SQL} SELECT CASE WHEN NOT contains(text, '```') THEN 'text' WHEN length(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '^\\s+|\\s+$', '', 'g')) > 100 THEN 'mixed' ELSE 'code' END AS content_type,
count(*)::BIGINT AS messages FROM fenced WHERE text IS NOT NULL GROUP BY 1""")
def content_type_stats(spark, sf_dir):
    df = fenced(spark, sf_dir).where("text is not null")
    return df.groupBy(parse.content_type(F.col("text")).alias("content_type")).agg(F.count(F.lit(1)).alias("messages"))


@query(f"""WITH {FENCE_SQL} SELECT conv_id, turn, regexp_extract(text, '(?s)```(\\w*)\\n(.*?)```', 1) AS language, trim(regexp_extract(text, '(?s)```(\\w*)\\n(.*?)```', 2), ' ' || chr(10)) AS content FROM fenced WHERE contains(text, '```')""")
def extract_code_blocks(spark, sf_dir):
    df = fenced(spark, sf_dir).select("conv_id", "turn", F.explode(parse.code_blocks(F.col("text"))).alias("b"))
    return df.select("conv_id", "turn", "b.language", "b.content")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, before::BIGINT AS before FROM w WHERE n <= 50 AND before <= 6000""")
def session_window(spark, sf_dir):
    return parse.session_window(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("before").cast("long").alias("before"))


@query("""SELECT conv_id, count(*)::BIGINT AS turns, coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0)::BIGINT AS user_chars FROM conversations GROUP BY 1 HAVING count(*) >= 4 AND coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0) >= 300""")
def session_gate(spark, sf_dir):
    return filters.session_gate(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, string_agg('[' || turn || '] ' || upper(role) || ': ' || CASE WHEN length(text) > 3000 THEN substr(text, 1, 2900) || chr(10) || '[... truncated ...]' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1""")
def conversation_prompts(spark, sf_dir):
    return parse.prompt(table(spark, sf_dir, "conversations"))


def _hashes(df: DataFrame) -> DataFrame:
    """A digest of each conversation's whole turns in their order; a turn without text is another than an empty one."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.sha2("text", 256), F.lit("")).alias("t"))))
    return df.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(said, lambda s: s["t"]), "|"), 256).alias("hash"))


HASH_SQL = "SELECT conv_id, sha256(string_agg(coalesce(sha256(text), ''), '|' ORDER BY turn)) AS hash FROM {} GROUP BY conv_id"


@query(f"""WITH b AS ({HASH_SQL.format("(SELECT * FROM conversations WHERE conv_id % 7 <> 0)")}), a AS ({HASH_SQL.format("(SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN text || ' edited' ELSE text END AS text FROM conversations WHERE conv_id % 11 <> 0)")})
SELECT conv_id, CASE WHEN b.hash IS NULL THEN 'new' WHEN a.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'changed' ELSE 'unchanged' END AS change FROM b FULL JOIN a USING (conv_id)""")
def change_detection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    later = c.where("conv_id % 11 <> 0").withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return upkeep.changes(_hashes(c.where("conv_id % 7 <> 0")), _hashes(later))


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE user_id % 3 = 0)")
def unprocessed_conversations(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("conv_id"))
    return upkeep.unprocessed(table(spark, sf_dir, "conversations").select("conv_id").distinct(), done, "conv_id")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply tree over the turns of each conversation: a turn answers the one its half points to."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("m"), t.cast("string")).alias("id"), F.when(t > 0, F.concat(F.lit("m"), F.floor((t - 1) / 2).cast("string"))).alias("parent_id"), t.alias("ord"), F.lpad((t * 7 % 5).cast("string"), 3, "0").alias("created_at"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn * 7 % 5 AS ts FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY id) AS nth FROM n),
w AS (SELECT conv_id, id, ts, ['m' || id] AS path, [nth] AS nths FROM k WHERE parent IS NULL UNION ALL SELECT k.conv_id, k.id, k.ts, list_append(w.path, 'm' || k.id), list_append(w.nths, k.nth) FROM k JOIN w ON k.conv_id = w.conv_id AND k.parent = w.id),
l AS (SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY ts DESC, nths) AS r FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = w.conv_id AND n.parent = w.id))
SELECT conv_id, array_to_string(path, '>') AS path FROM l WHERE r = 1""")
def primary_path(spark, sf_dir):
    from memlake.operators.parse import primary_path as path

    return path(_tree(spark, sf_dir)).select("conv_id", F.array_join("path", ">").alias("path"))


@query("""SELECT conv_id, count(*)::BIGINT AS branches_found FROM (SELECT conv_id, (turn - 1) // 2 AS p FROM conversations WHERE turn > 0 GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def branch_counts(spark, sf_dir):
    return parse.branch_counts(_tree(spark, sf_dir))


# ---------------------------------------------------------------- search and merge

TOPK_SQL = """q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]) AS similarity FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s)"""


def _hits(spark, sf_dir, k: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.vector_topk(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, k)


@query(f"WITH {TOPK_SQL} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM t WHERE r <= 10")
def cosine_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 10).withColumn("similarity", F.round("similarity", 6))


RERANK_SQL = f"""WITH {ENTRIES_SQL}, {TOPK_SQL}, h AS (SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM t WHERE r <= 40),
e AS (SELECT h.*, e.salience, CASE WHEN e.tier = 2 AND h.similarity < 0.65 THEN 3 ELSE e.tier END AS tier, epoch(TIMESTAMP '{NOW}' - e.last_seen) / 86400.0 AS days FROM h JOIN entries e ON h.vec_id = e.entry_id WHERE NOT e.archived),
f AS (SELECT *, floor((0.55 * similarity + 0.15 * CASE WHEN days <= 7 THEN 1.0 ELSE 0.9 END + 0.3 * salience)::DOUBLE * CASE tier WHEN 1 THEN 1.15 WHEN 2 THEN 1.0 ELSE 0.85 END::DOUBLE * 10000 + 0.5) / 10000 AS final_score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, final_score DESC, similarity DESC, vec_id) AS place FROM f {{}})
SELECT query_id, place::INTEGER AS place, vec_id AS entry_id, tier::INTEGER AS effective_tier, final_score, similarity FROM o WHERE place <= 5"""


@query(RERANK_SQL.format(""))
def search_rerank(spark, sf_dir):
    return search.search(_hits(spark, sf_dir, 40).withColumn("similarity", F.round("similarity", 6)), entries(spark, sf_dir), NOW)


@query(RERANK_SQL.format("WHERE tier = 3"))
def search_tier_filter(spark, sf_dir):
    return search.search(_hits(spark, sf_dir, 40).withColumn("similarity", F.round("similarity", 6)), entries(spark, sf_dir), NOW, tier=3)


def _sides(spark, sf_dir):
    """New and stored entries over documents with a vector: labels of four words, a repository by id."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    words = F.array_join(F.slice(S.tokens(F.col("text")), 1, 4), " ")
    e = d.select(F.col("doc_id").alias("entry_id"), words.alias("label"), F.array(F.concat(F.lit("r"), (F.col("doc_id") % 40).cast("string"))).alias("repos"), "embedding")
    return e.where("entry_id % 4 = 0"), e.where("entry_id % 4 <> 0")


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS w, doc_id % 40 AS repo, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
u AS (SELECT doc_id, repo, v, list_filter(w, lambda x, i: list_position(w, x) = i)[1:4] AS w FROM d),
p AS (SELECT n.doc_id AS new_id, o.doc_id AS old_id, list_cosine_similarity(n.v, o.v) AS similarity, len(list_intersect(n.w, o.w)) >= 2 AS words, n.repo = o.repo AS repo FROM u n, u o WHERE n.doc_id % 4 = 0 AND o.doc_id % 4 <> 0),
s AS (SELECT *, words::INT + repo::INT + (similarity > 0.25)::INT AS signals FROM p WHERE words OR repo), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_id) AS r FROM s WHERE signals >= 2 AND similarity > 0)
SELECT u.doc_id AS new_id, coalesce(r.old_id, -1) AS old_id, round(coalesce(r.similarity, 0), 6) AS similarity, CASE WHEN r.similarity IS NULL THEN 'create' WHEN r.similarity > 0.4 THEN 'update' WHEN r.similarity > 0.3 THEN 'evolve' ELSE 'contest' END AS action
FROM u LEFT JOIN r ON u.doc_id = r.new_id AND r.r = 1 WHERE u.doc_id % 4 = 0""")
def merge_actions(spark, sf_dir):
    new, old = _sides(spark, sf_dir)
    return merge.merge_log(new, merge.matches(new, old, near=0.25), 0.4, 0.3).withColumns({"old_id": F.coalesce("old_id", F.lit(-1)), "similarity": F.round(F.coalesce("similarity", F.lit(0.0)), 6)})


@query(f"""WITH a AS (SELECT item_id, array_to_string(string_split({NORM.format('text')}, ' ')[1:2], ' ') AS asked FROM benchmark), l AS (SELECT doc_id, {NORM.format('substr(text, 1, 60)')} AS label FROM documents),
j AS (SELECT item_id, doc_id, CASE WHEN asked = label THEN 1 WHEN contains(label, asked) THEN 2 WHEN len(list_filter(string_split(asked, ' '), lambda w: NOT contains(label, w))) = 0 THEN 3 END AS rank FROM a, l)
SELECT item_id, min_by(doc_id, rank::BIGINT * 1000000000000 + doc_id) AS doc_id, min(rank)::INTEGER AS rank FROM j WHERE rank IS NOT NULL GROUP BY 1""")
def domain_lookup(spark, sf_dir):
    """The benchmark items are the stated questions; every document's label is looked at."""
    first = F.array_join(F.slice(F.split(S.comparable(F.col("text")), " "), 1, 2), " ")
    asked = table(spark, sf_dir, "benchmark").select("item_id", first.alias("asked"))
    labels = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("label"))
    found = search.labels_matching(asked, labels)
    return found.groupBy("item_id").agg(F.min(F.struct("rank", "doc_id")).alias("m")).select("item_id", "m.doc_id", "m.rank")


# ---------------------------------------------------------------- compression, upkeep, mail, rates

@query(f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'compressed' ELSE 'full' END AS detail, CASE WHEN doc_id % 11 = 0 THEN 'contested' ELSE 'active' END AS state,
TIMESTAMP '{NOW}' - to_days((doc_id % 200)::INTEGER) AS updated, doc_id % 5 AS access, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '{NOW}' - to_days((doc_id % 120)::INTEGER) END AS evolved FROM documents)
SELECT doc_id, CASE WHEN detail = 'compressed' THEN 'already_compressed' WHEN state = 'contested' THEN 'contested' WHEN epoch(TIMESTAMP '{NOW}' - updated) / 86400 <= 90 THEN 'recently_updated' WHEN access >= 3 THEN 'often_accessed'
WHEN epoch(TIMESTAMP '{NOW}' - evolved) / 86400 <= 60 THEN 'recently_evolved' END AS reason FROM e""")
def compression_eligibility(spark, sf_dir):
    d = F.col("doc_id")
    ago = lambda n: F.lit(NOW).cast("timestamp") - F.make_dt_interval((d % n).cast("int"))
    e = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 6 == 0, "compressed").otherwise("full").alias("detail"), F.when(d % 11 == 0, "contested").otherwise("active").alias("state"), ago(200).alias("updated"), (d % 5).alias("access"), F.when(d % 3 == 0, ago(120)).alias("evolved"))
    return e.select("doc_id", filters.compression_reason(F.col("detail"), F.col("state"), F.col("updated"), F.col("access"), F.col("evolved"), NOW).alias("reason"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'task_query' WHEN quality = 1 THEN 'explicit_save' ELSE 'other' END AS c FROM labels)
SELECT d.doc_id AS entry_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.c = 'other' THEN 'bad_type' END AS issue FROM documents d LEFT JOIN l USING (doc_id) WHERE l.doc_id IS NULL OR l.c = 'other'""")
def classification_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), F.when(F.col("toxic") == 1, "task_query").when(F.col("quality") == 1, "explicit_save").otherwise("other").alias("context_type"))
    e = raw_entries(spark, sf_dir).withColumn("classification_status", F.lit("pending"))
    return upkeep.classified(e, labels)[1]


@query(f"""WITH {ENTRIES_SQL}, v AS (SELECT vec_id AS entry_id, CASE WHEN vec_id % 17 = 0 THEN 'stale' WHEN vec_id % 11 = 0 THEN 'contested' ELSE 'active' END AS state FROM embeddings)
SELECT e.entry_id, CASE WHEN v.entry_id IS NULL THEN 'missing_vector' ELSE 'metadata_mismatch' END AS issue FROM entries e LEFT JOIN v USING (entry_id) WHERE NOT archived AND (v.entry_id IS NULL OR v.state <> e.state)""")
def verify_consistency(spark, sf_dir):
    i = F.col("vec_id")
    v = table(spark, sf_dir, "embeddings").select(i.alias("entry_id"), F.when(i % 5 == 0, "project").otherwise("knowledge").alias("entry_type"), F.when(i % 17 == 0, "stale").when(i % 11 == 0, "contested").otherwise("active").alias("state"))
    return upkeep.consistency(raw_entries(spark, sf_dir).withColumn("schema_version", F.lit(2)), v)


@query(f"""WITH {ENTRIES_SQL} SELECT entry_id, greatest(n_sources, mention_count)::BIGINT AS mention_count, tier::INTEGER AS tier, n_sources::INTEGER AS n_sources, last_seen FROM entries""")
def normalize_metadata(spark, sf_dir):
    e = raw_entries(spark, sf_dir).withColumns({"created_at": F.col("updated_at"), "first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    return upkeep.normalized(e, F.lit(NOW).cast("timestamp")).select("entry_id", "mention_count", "tier", F.size("sources").alias("n_sources"), "last_seen")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, user_id AS key, count(*)::BIGINT AS calls, count(*) <= 1 AS allowed FROM events GROUP BY 1, 2""")
def rate_limit_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"))
    return rate_windows(e, 1)


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, ' of ', ' because '), chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
SELECT doc_id AS path, (i - 1)::INTEGER AS line_no, substr(array_to_string(l[greatest(1, i - 2):i + 2], chr(10)), 1, 300) AS comment FROM p WHERE regexp_matches(lower(l[i]), 'because|reason:|why:|note:|important:|todo:|hack:|workaround')""")
def rationale_windows(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.replace("text", F.lit(" of "), F.lit(" because ")).alias("content"))
    return mail.rationale(files)


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\. ', '.' || chr(10), 'g') || chr(10) || 'on monday x wrote:' || chr(10) || 'old', chr(10)) AS l FROM conversations),
p AS (SELECT conv_id, turn, l, list_position(list_transform(l, lambda x: regexp_matches(lower(trim(x)), 'get outlook for|sent from my|---------- forwarded message|on .* wrote:|from:.*sent:.*to:.*subject:|_{5,}')), true) AS p FROM l)
SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(l[1:p - 1], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM p""")
def clean_mail_body(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mail.clean_body(F.concat(F.regexp_replace("text", r"\. ", ".\n"), F.lit("\non monday x wrote:\nold"))).alias("body"))


TRIM_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/?p|/?div|/?li|/?tr|/?h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, {TRIM_SQL.format("regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')")} AS text FROM c""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", mail.html_text(F.col("html")).alias("text"))


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(0, n - 21) + 1, 180)) AS s FROM w WHERE n > 0)
SELECT doc_id, (s // 180)::INTEGER AS n, least(200, n - s)::INTEGER AS size FROM c""")
def token_chunks(spark, sf_dir):
    words = F.array_remove(F.split("text", r"\s+"), "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parse.chunks(words, 200, 20)).alias("n", "tokens"))
    return d.select("doc_id", "n", F.size("tokens").alias("size"))


def _mutations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("update", "insight", "archive", "restore", "create"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("mutation_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("user_id").alias("entry_id"), F.lit(None).cast("int").alias("expected_revision"), F.col("event_type").alias("view"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("context_type"), F.col("event_type").alias("insight"))


#: Mutations one after another: the state of every entry after its n-th, told by what it was after the one before.
FOLD_SQL = f"""WITH RECURSIVE m AS (SELECT user_id AS entry_id, 'm' || event_id AS mutation_id, ['update', 'insight', 'archive', 'restore', 'create'][event_id % 5 + 1] AS kind, event_type AS insight,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, 'm' || event_id) AS n FROM events),
e AS (SELECT doc_id AS entry_id, doc_id % 13 = 0 AS archived, [substr(text, 1, 60)] AS insights FROM documents WHERE doc_id % 5 <> 0),
r AS (SELECT i.entry_id, 0::BIGINT AS n, e.entry_id IS NOT NULL AS there, 0 AS revision, coalesce(archived, FALSE) AS archived, coalesce(insights, []::VARCHAR[]) AS insights, NULL::VARCHAR AS mutation_id, NULL::VARCHAR AS status
  FROM (SELECT DISTINCT entry_id FROM m) i LEFT JOIN e USING (entry_id)
UNION ALL SELECT entry_id, n2, there OR (st = 'ok' AND kind = 'create'), CASE WHEN st = 'ok' AND kind = 'create' THEN 1 WHEN st = 'ok' THEN revision + 1 ELSE revision END,
  CASE WHEN st = 'ok' AND kind = 'archive' THEN TRUE WHEN st = 'ok' AND kind = 'restore' THEN FALSE ELSE archived END, CASE WHEN st = 'ok' AND kind IN ('create', 'insight') AND insight IS NOT NULL THEN list_append(insights, insight) ELSE insights END, mid, st
  FROM (SELECT r.entry_id, r.there, r.revision, r.archived, r.insights, m.kind, m.insight, m.mutation_id AS mid, m.n AS n2, CASE WHEN kind = 'create' AND there THEN 'exists' WHEN kind <> 'create' AND NOT there THEN 'not_found' WHEN archived AND kind <> 'restore' THEN 'archived'
    WHEN NOT archived AND kind = 'restore' THEN 'conflict' WHEN kind = 'insight' AND list_contains(list_transform(insights, lambda x: {NORM.format("x")}), {NORM.format("m.insight")}) THEN 'noop' ELSE 'ok' END AS st
    FROM r JOIN m ON m.entry_id = r.entry_id AND m.n = r.n + 1))
SELECT entry_id, mutation_id, status, revision FROM r WHERE status IS NOT NULL"""


@query(FOLD_SQL)
def mutation_fold(spark, sf_dir):
    e = raw_entries(spark, sf_dir).where("entry_type = 'knowledge'").select("entry_id", F.lit(0).alias("revision"), "archived", F.substring("narrative", 1, 80).alias("view"), "confidence", "state", "context_type", F.array(F.col("label")).alias("insights"))
    return mutate.fold(e, _mutations(spark, sf_dir))[1]


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'explicit_save' ELSE context_type END AS context_type, CASE WHEN entry_id % 2 = 0 THEN FALSE ELSE archived OR entry_id % 4 = 1 END AS archived FROM entries")
def archive_restore_roundtrip(spark, sf_dir):
    e = entries(spark, sf_dir)
    gone, snaps = lifecycle.archived(e, e.where("entry_id % 2 = 0 or entry_id % 4 = 1").select("entry_id"), "r1", NOW, "test")
    return lifecycle.restored(gone, snaps, e.where("entry_id % 2 = 0").select("entry_id")).select("entry_id", "context_type", "archived")


@query(f"""WITH {ENTRIES_SQL} SELECT {", ".join(f"count_if({BUCKET_SQL} = '{b}')::BIGINT AS {b}" for b in ("stable", "active", "weak", "decay_candidate"))} FROM entries WHERE NOT archived""")
def cycle_report(spark, sf_dir):
    return lifecycle.cycle(raw_entries(spark, sf_dir), access(spark, sf_dir), F.lit(NOW).cast("timestamp"), "run1")["run"].select("stable", "active", "weak", "decay_candidate")


@query("SELECT year(ts)::INTEGER AS year, count(*)::BIGINT AS mails FROM events GROUP BY 1")
def mails_by_year(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("mails"))
