"""Conversations: trees to primary paths, messages, code blocks, prompts, session turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from memlake.plans.tables import delete_stored, stored

FENCED = r"(?s)```(\w*)\n(.*?)```"


def code_blocks(text: Column) -> Column:
    """Array of (language or null, content) of fenced blocks."""
    kind, body = F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), F.regexp_extract_all(text, F.lit(FENCED), F.lit(2))
    return F.zip_with(kind, body, lambda k, b: F.struct(F.nullif(k, F.lit("")).alias("language"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("content")))


def content_type(text: Column) -> Column:
    rest = F.length(F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", ""), r"^\s+|\s+$", ""))
    return F.when(~text.contains("```"), "text").when(rest > 100, "mixed").otherwise("code")


def edges(nodes: DataFrame) -> DataFrame:
    """Message graph of (conv_id, id, parent_id, ord, ...): adds is_root for each conversation's first root, where a
    root has no parent, or in a conversation without one, a parent that is not in it."""
    ids = nodes.select("conv_id", F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    df = nodes.join(ids, ["conv_id", "parent_id"], "left")
    free = F.max(F.col("parent_id").isNull().cast("int")).over(W.partitionBy("conv_id"))
    root = F.when(free == 1, F.col("parent_id").isNull()).otherwise(F.col("known").isNull())
    df = df.withColumn("root", root)
    first = F.row_number().over(W.partitionBy("conv_id", "root").orderBy("ord", "id"))
    return df.withColumn("is_root", F.col("root") & (first == 1)).drop("known", "root")


def tour(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes (conv_id, id, is_root, created_at) of reply trees with their place on a walk through their tree: ``enter`` and
    ``leave``, counted from the walk's end, ``depth``, and ``in_main``, whether the tree is that of the conversation's first
    root. Children come by (ord, id); of rows with one id in a conversation the first by ord counts.

    The walk goes down to the first child, else on to the next sibling, else back up; so every step knows the one after
    it, and steps learn their distance from the end by jumping: each round a step adds up what its target knows and
    points where the target pointed. Rows stay of one size, and a chain of any length takes its logarithm in rounds.
    Steps on a parent cycle never end; when a round brings no step to its end all that are left are such, and their
    nodes have a null place. Stored."""
    first = F.row_number().over(W.partitionBy("conv_id", "id").orderBy("ord", "parent_id"))
    df = edges(nodes.withColumn("__r", first).where("__r = 1").drop("__r"))
    df = stored(df.select("conv_id", "id", "parent_id", "ord", "is_root", "created_at", F.monotonically_increasing_id().alias("node")), "tour-nodes")
    df = df.join(df.select("conv_id", F.col("id").alias("parent_id"), F.col("node").alias("up")), ["conv_id", "parent_id"], "left")
    df = df.withColumn("next", F.when(F.col("up").isNotNull(), F.lead("node").over(W.partitionBy("up").orderBy("ord", "id"))))
    down = df.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.min(F.struct("ord", "id", "node"))["node"].alias("down"))
    df = df.join(down, "node", "left")
    # Steps: 2 * node goes into a node, 2 * node + 1 leaves it. ``rise``: what the steps to the end add to the depth.
    into = F.struct((F.col("node") * 2).alias("step"), F.coalesce(F.col("down") * 2, F.col("node") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("rise"))
    out = F.struct((F.col("node") * 2 + 1).alias("step"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("to"), F.lit(-1).cast("long").alias("rise"))
    steps = df.select(F.explode(F.array(into, out)).alias("s")).select("s.*")
    steps, is_open = _told_open(steps.select("step", "to", F.lit(1).cast("long").alias("left"), "rise", F.when(F.col("to").isNull(), F.col("step")).alias("end")))
    open_before = None
    for _ in range(rounds):
        if is_open in (0, open_before):
            break
        open_before = is_open
        target = steps.select(F.col("step").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"), F.col("rise").alias("rise2"), F.col("end").alias("end2"))
        more = steps.where("to is not null").join(target, "to").select("step", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"), (F.col("rise") + F.col("rise2")).alias("rise"), F.col("end2").alias("end"))
        new, is_open = _told_open(steps.where("to is null").unionByName(more))
        delete_stored(steps)
        steps = new
    known = steps.withColumn("left", F.when(F.col("to").isNull(), F.col("left")))
    ends = known.groupBy(F.shiftright("step", 1).alias("node")).agg(
        F.max(F.when(F.col("step") % 2 == 0, F.col("left"))).alias("enter"), F.max(F.when(F.col("step") % 2 == 1, F.col("left"))).alias("leave"),
        F.max(F.when(F.col("step") % 2 == 0, -F.col("rise"))).alias("depth"), F.max("end").alias("end"),
    )
    named = df.select("conv_id", "id", "node", "is_root", "created_at").join(ends, "node")
    main = df.where("is_root").select((F.col("node") * 2 + 1).alias("end"), F.lit(True).alias("main"))
    return stored(named.join(main, "end", "left").select("conv_id", "id", "is_root", "created_at", "enter", "leave", F.when(F.col("enter").isNotNull(), F.col("depth")).alias("depth"), F.coalesce(F.col("main") & F.col("enter").isNotNull(), F.lit(False)).alias("in_main")), "tour")


def _told_open(steps: DataFrame) -> tuple[DataFrame, int]:
    """Steps as stored, and how many of them have not come to an end, counted as they were written."""
    seen = Observation()
    table = stored(steps.observe(seen, F.count_if(F.col("to").isNotNull()).alias("open")), "tour-steps")
    return table, seen.get["open"]


def cyclic_nodes(walked: DataFrame) -> DataFrame:
    """(conv_id, id) of nodes of a ``tour`` that stand on a cycle of parents or below one; no path leads to them."""
    return walked.where("enter is null").select("conv_id", "id")


def primary_messages(walked: DataFrame) -> DataFrame:
    """(conv_id, turn, id): of a ``tour`` the nodes from the first root down to the latest leaf below it, which is where
    taking the branch with the latest leaf at each fork ends. Ties go to the smaller child ordinals along the path, so
    to what the walk comes to first; a missing time is earliest. A row a message: no conversation is gathered."""
    main = walked.where("in_main")
    late = F.struct(F.col("created_at").isNotNull().alias("known"), "created_at", "enter")
    best = main.where("enter - leave = 1").groupBy(F.struct("conv_id").alias("key")).agg(F.max(late)["enter"].alias("goal"))
    on = main.withColumn("key", F.struct("conv_id")).join(best, "key").where("enter >= goal and leave < goal")
    return on.select("conv_id", F.col("depth").cast("int").alias("turn"), "id")


def primary_path(nodes: DataFrame) -> DataFrame:
    """(conv_id, path): ids of ``primary_messages`` in order, an array a conversation. A conversation whose nodes are all on
    cycles has none."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "id")))
    return primary_messages(tour(nodes)).groupBy("conv_id").agg(F.transform(rows, lambda r: r["id"]).alias("path"))


def branch_counts(nodes: DataFrame) -> DataFrame:
    """(conv_id, branches_found): messages with more than one reply."""
    forks = nodes.where("parent_id is not null").groupBy("conv_id", "parent_id").count().where("count > 1")
    return forks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("branches_found"))


def normalized_role(role: Column) -> Column:
    """human and developer count as user; what is neither user nor assistant is null."""
    return F.when(role.isin("human", "user", "developer"), "user").when(role == "assistant", "assistant")


def messages(turns: DataFrame) -> DataFrame:
    """Messages of users and assistants of (conv_id, turn, role, text), with kind and code blocks."""
    df = turns.withColumn("role", normalized_role(F.col("role"))).where("role is not null")
    return df.withColumns({"content_type": content_type(F.col("text")), "code_blocks": code_blocks(F.col("text"))})


def conversation_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.coalesce(F.bool_or(F.col("text").contains("```")), F.lit(False)).alias("has_code"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_length"),
    )


def unknown_message_ids(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, message_id) that no message has."""
    return evidence.join(turns.select("conv_id", F.col("turn").alias("message_id")).distinct(), ["conv_id", "message_id"], "left_anti")


def prompt(turns: DataFrame, most: int = 3000, kept: int = 2900) -> DataFrame:
    """(conv_id, prompt): every message as [id] ROLE: content, long ones cut, a blank line between."""
    body = F.when(F.length("text") > most, F.concat(F.substring("text", 1, kept), F.lit("\n[... truncated ...]"))).otherwise(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.upper("role"), F.lit(": "), body)
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("prompt"))


def session_window(turns: DataFrame, key: str = "conv_id", most: int = 50, signs: int = 6000) -> DataFrame:
    """The first ``most`` turns until their length has passed ``signs``; the one that passes it is in."""
    w = W.partitionBy(key).orderBy("turn")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumns({"n": F.row_number().over(w), "before": before}).where((F.col("n") <= most) & (F.col("before") <= signs)).drop("n")


def session_lines(lines: DataFrame) -> DataFrame:
    """Session logs of either dialect line by line, from (path, line_no, line): role, whole text, and what the line says
    of time, folder and session. Bad lines go. Nothing here looks at other lines, so a stream can store the rows."""
    block = "array<struct<type:string,text:string>>"
    j = lambda p: F.get_json_object("line", p)
    text = lambda p, kinds: F.coalesce(
        F.array_join(F.transform(F.filter(F.from_json(j(p), block), lambda b: b["type"].isin(*kinds)), lambda b: b["text"]), "\n"), F.when(~F.coalesce(j(p), F.lit("")).startswith("["), j(p))
    )
    one, two = j("$.message").isNotNull(), j("$.payload").isNotNull()
    return lines.where(F.try_parse_json("line").isNotNull()).select(
        "path", "line_no", F.when(two, F.lit("second")).when(one, F.lit("first")).alias("dialect"),
        normalized_role(F.when(two, j("$.payload.role")).otherwise(j("$.type"))).alias("role"),
        F.regexp_replace(F.when(two, text("$.payload.content", ("text", "output_text", "input_text"))).otherwise(text("$.message.content", ("text",))), r"^\s+|\s+$", "").alias("text"),
        j("$.timestamp").alias("timestamp"), F.coalesce(j("$.payload.cwd"), j("$.cwd")).alias("cwd"), F.coalesce(j("$.sessionId"), j("$.payload.id")).alias("session_id"),
    )


def carried(rows: DataFrame, cap: int = 800) -> DataFrame:
    """Turns of ``session_lines``: texts of at most ``cap`` signs, with the working folder known so far in the file (in the
    first dialect: anywhere in it). Blank texts go."""
    w = W.partitionBy("path").orderBy("line_no")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = F.when(F.col("dialect") == "second", F.last("cwd", True).over(w)).otherwise(F.first("cwd", True).over(whole))
    df = rows.withColumns({"cwd": seen, "text": F.substring("text", 1, cap)})
    return df.where("role is not null and text <> ''")


def session_turns(lines: DataFrame, cap: int = 800) -> DataFrame:
    """Turns of session logs of either dialect, from (path, line_no, line)."""
    return carried(session_lines(lines), cap)


def chunks(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens that overlap; the last one ends with the text."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - overlap - 1), F.lit(step))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def token_estimate(text: Column) -> Column:
    return F.round(F.length(text) / 4).cast("long")


def model_json(text: Column) -> Column:
    """The JSON array of a model's answer: fences go, then what lies between the first [ and the last ]."""
    bare = F.regexp_replace(text, r"(?m)^```\w*\s*$", "")
    return F.regexp_extract(bare, r"(?s)\[.*\]", 0)


def git_remote(url: Column) -> Column:
    """(owner, repo) of an ssh or https remote."""
    rx = r"github\.com[:/]([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
    return F.struct(F.nullif(F.regexp_extract(url, rx, 1), F.lit("")).alias("owner"), F.nullif(F.regexp_extract(url, rx, 2), F.lit("")).alias("repo"))


def entry_id(source: Column, content: Column) -> Column:
    return F.concat(F.lit("ke_"), F.substring(F.sha2(F.concat(source, F.lit(":"), F.substring(content, 1, 500)), 256), 1, 12))
