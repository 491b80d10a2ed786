"""Value filter for conversations, session and mail gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Phrases that mark what a conversation is worth, as lower-case regular expressions between word borders.
DECISION = (
    r"i decided|i'll go with|let's go with|the answer is|i'm going to use|i chose",
    r"we'll use|we decided|the decision is|i've decided",
    r"settled on|going with|picked|selected",
)
LEARNING = (
    r"i see|that makes sense|i didn't know|i understand now",
    r"oh interesting|that's interesting|good to know|makes sense",
    r"i learned|til|now i get it|ah okay",
)
CONCLUSION = (
    r"in summary|to summarize|in conclusion|so basically",
    r"the key takeaway|main points|key points|bottom line",
    r"to recap|wrapping up|final answer",
)
TROUBLE = (
    r"error|exception|failed|not working|doesn't work|broken",
    r"fix|debug|issue|bug|problem",
    r"help me|can you help|why isn't|what's wrong",
)
META = (
    r"can you|are you able|do you have|what are your capabilities",
    r"as an ai|as a language model|i cannot|i'm unable",
)
PROJECT = (r"[\p{L}\p{N}_]+\s+(?:project|repo|repository|codebase)",)
REPOSITORY = r"github\.com/[a-z0-9_]+/[a-z0-9_]+|[a-z0-9_-]+/[a-z0-9_-]+\s+(?:repo|repository)"
AI_WORDS = (r"ai|language model|capabilities|can you",)
THRESHOLD = 3
EDGE = r"(?:^|[^\p{L}\p{N}_])(?:WORDS)(?:$|[^\p{L}\p{N}_])"


def phrase(words: tuple[str, ...]) -> str:
    """A pattern for any of the phrases between borders that are the same in every engine."""
    return EDGE.replace("WORDS", "|".join(words))


def _neighbours(turns: DataFrame, reach: int) -> DataFrame:
    """Each turn with what of the turns before a phrase of fewer than ``reach`` signs could begin in: of all turns (``t``)
    and of the user's (``u``), else the turn alone. A turn adds at least the space before the next, so no more than
    ``reach`` turns are looked back at, and of each no more than its last ``reach`` signs."""
    x = F.lower("said")
    order = ("turn", "role", "said")
    side = W.partitionBy("conv_id", "by_user").orderBy(*order)
    whole = W.partitionBy("conv_id").orderBy(*order)

    def led(w) -> Column:
        # The sign before hides where the text was cut, so that no phrase begins there.
        before = F.array_join(F.collect_list(F.right(x, F.lit(reach))).over(w.rowsBetween(-reach, -1)), " ")
        return F.concat(F.lit("_"), F.right(F.concat(F.lit(" "), before), F.lit(reach)), F.lit(" "), x)

    before = whole.rowsBetween(W.unboundedPreceding, -1)
    ends = lambda rx: F.coalesce(F.last(F.when(x.rlike(r"\S"), x.rlike(rx + r"\s*\z")), True).over(before), F.lit(False))
    by_user = F.coalesce(F.col("role") == "user", F.lit(False))
    df = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said"), by_user.alias("by_user")).repartition("conv_id")
    return df.withColumn("u", F.when(F.col("by_user"), led(side))).withColumns({
        "t": led(whole), "x": x, "place": F.row_number().over(whole), "last": F.lead(F.lit(1), 3).over(whole).isNull(),
        "after_word": ends(r"[\p{L}\p{N}_]"), "after_path": ends(r"[a-z0-9_-]/[a-z0-9_-]+"),
    })


def scored(turns: DataFrame, threshold: int = THRESHOLD, projects: tuple[str, ...] = ()) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text): signals, value_score, decision and skip_reason. Kept and
    skipped conversations both stay. ``projects`` are names, in lower case, that count as a reference to a project besides
    the general pattern.

    Signals are those of a conversation's texts joined by spaces in order of turn (ties: role, then text; a null text is
    empty), but a conversation is never joined: it streams through its task in order, each turn is looked at with as much
    of those before as a phrase could begin in, and what the turns show is added up. Only the last three turns, and the
    first five, for a rule about conversations under six, are held. One shuffle by conversation."""
    fixed = [p for words in (DECISION, LEARNING, CONCLUSION, TROUBLE, META) for alternatives in words for p in alternatives.split("|")]
    df = _neighbours(turns, max(map(len, [*fixed, *projects])) + 1)
    has = lambda c, words: F.coalesce(F.bool_or(F.col(c).rlike(phrase(words))), F.lit(False))
    count = lambda role: F.count_if(F.col("role") == role)
    held = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.struct("place", "role", "x"))))
    # A name and the word that tells its kind may stand in two turns, with blank ones between.
    led_project = F.col("after_word") & F.col("x").rlike(r"^\s*(?:project|repo|repository|codebase)(?:\z|[^\p{L}\p{N}_])")
    led_repository = F.col("after_path") & F.col("x").rlike(r"^\s*repo")
    named = has("t", projects) if projects else F.lit(False)
    df = df.groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_messages"), F.least(count("user"), count("assistant")).cast("int").alias("exchanges"), F.bool_or(F.col("x").contains("```")).alias("has_code"),
        has("t", DECISION).alias("decided"), has("u", LEARNING).alias("learned"), (has("x", PROJECT) | F.bool_or(led_project) | named).alias("project"),
        F.bool_or(F.col("x").rlike(REPOSITORY) | led_repository).alias("repository"), has("t", TROUBLE).alias("troubled"), has("t", CONCLUSION).alias("ever_concluded"), has("t", META).alias("about"),
        held(F.col("last")).alias("end"), held(F.col("place") <= 5).alias("start"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda m: m["x"]), " ")
    df = df.withColumns({
        "concluded": joined("end").rlike(phrase(CONCLUSION)), "trouble": F.col("troubled") & ~F.col("decided") & ~F.col("ever_concluded"),
        "meta": F.col("about") & (F.col("n_messages") < 6) & (F.regexp_count(joined("start"), F.lit(phrase(AI_WORDS))) > 3),
        "abandoned": (F.col("n_messages") >= 3) & F.forall("end", lambda m: F.coalesce(m["role"] == "assistant", F.lit(False))),
    })
    points = (("has_code", 3), ("decided", 3), ("learned", 2), ("project", 2), ("repository", 2), ("concluded", 2), ("trouble", -2), ("meta", -3), ("abandoned", -2))
    score = F.least(F.floor(F.col("exchanges") / 5), F.lit(3)).cast("int")
    for name, n in points:
        score = score + F.when(F.col(name), n).otherwise(0)
    df = df.withColumn("value_score", score).withColumn("decision", F.when(F.col("value_score") >= threshold, "keep").otherwise("skip"))
    reason = F.when(F.col("decision") == "keep", None).when(F.col("trouble"), "pure_troubleshooting").when(F.col("meta"), "meta_about_ai").when(F.col("abandoned"), "abandoned_thread")
    df = df.withColumn("skip_reason", reason.when(F.col("value_score") <= 0, "no_value_signals").otherwise("below_threshold"))
    return df.drop("troubled", "ever_concluded", "about", "end", "start")


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("value_score").agg(F.count(F.lit(1)).alias("conversations")).orderBy("value_score")


def session_gate(turns: DataFrame, least_turns: int = 4, least_signs: int = 300) -> DataFrame:
    """Conversations with enough turns and enough said by the user."""
    said = F.coalesce(F.sum(F.when(F.col("role") == "user", F.length("text"))), F.lit(0))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), said.alias("user_chars")).where((F.col("turns") >= least_turns) & (F.col("user_chars") >= least_signs))


def archive_candidate(context_type: Column, mentions: Column, access: Column, salience: Column, least: float) -> Column:
    return context_type.isin("task_query", "passing_reference") & (mentions == 1) & (access == 0) & (salience < least)


def promotion_candidate(context_type: Column, mentions: Column, access: Column, sources: Column, least: int) -> Column:
    return (context_type == "task_query") & (mentions >= least) & ((access > 0) | (sources > 1))


def compression_reason(detail: Column, state: Column, updated: Column, access: Column, last_evolution: Column, now, idle: int = 90, most_access: int = 3, calm: int = 60) -> Column:
    """Why an entry is not compressed, or null where it is to be; a missing time hinders nothing."""
    age = lambda t: F.coalesce((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(t)) / 86400e6, F.lit(1e9))
    return F.when(detail == "compressed", "already_compressed").when(state == "contested", "contested").when(age(updated) <= idle, "recently_updated").when(access >= most_access, "often_accessed").when(age(last_evolution) <= calm, "recently_evolved")
