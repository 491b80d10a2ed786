"""Mail and code: gates, cleaned bodies, plain text of pages, rationale comments, substantive commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What marks automated mail and the end of a body.
SENDERS = (r"noreply", r"no-reply", r"donotreply", r"notifications?@", r"alert@", r"mailer-daemon", r"postmaster")
SUBJECTS = ("your order", "order confirmation", "shipping confirmation", "receipt for", "payment received", "password reset", "verify your email", "subscription", "unsubscribe", "newsletter")
STOPS = (r"get outlook for", r"sent from my", r"---------- forwarded message", r"on .* wrote:", r"from:.*sent:.*to:.*subject:", r"_{5,}")
KEYWORDS = ("because", "reason:", "why:", "note:", "important:", "todo:", "hack:", "workaround")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def automated(sender: Column, subject: Column, domains: tuple[str, ...] = ()) -> Column:
    s, t = F.lower(F.coalesce(sender, F.lit(""))), F.lower(F.coalesce(subject, F.lit("")))
    out = s.rlike("|".join(SENDERS)) | t.rlike("|".join(SUBJECTS))
    for d in domains:
        out = out | s.contains(d)
    return out


def clean_body(text: Column) -> Column:
    """Lines before the first mark of a signature or an older mail, without quoted ones, blank runs squeezed."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    stop = F.array_position(F.transform(lines, lambda x: F.lower(F.trim(x)).rlike("|".join(STOPS))), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    body = F.regexp_replace(F.array_join(kept, "\n"), r"(?m)^>.*$", "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def mail_gate(mail: DataFrame, first_year: int = 2020, least: int = 150, domains: tuple[str, ...] = ()) -> DataFrame:
    """Mail (id, date, subject, sender, content) that a person wrote, with a date and enough left of the body."""
    df = mail.withColumns({"day": F.try_to_timestamp("date"), "content": clean_body(F.col("content"))})
    return df.where(F.col("day").isNotNull() & (F.year("day") >= first_year) & (F.length("content") >= least) & ~automated(F.col("sender"), F.col("subject"), domains))


def html_text(html: Column) -> Column:
    """Plain text of a page: script, style and head go, blocks end lines, entities are signs again."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/?p|/?div|/?li|/?tr|/?h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def rationale(files: DataFrame, around: int = 2, cut: int = 300) -> DataFrame:
    """(path, line_no, comment): lines of (path, content) with a word of reasoning, two lines around each. Lines come from
    the row's own array, so no line is shuffled."""
    df = files.withColumn("__l", F.split("content", "\n"))
    df = df.select("path", "__l", F.posexplode("__l").alias("line_no", "line")).where(F.lower("line").rlike("|".join(KEYWORDS)))
    first = F.greatest(F.lit(0), F.col("line_no") - around)
    near = F.slice("__l", first + 1, F.col("line_no") - first + around + 1)
    return df.select("path", "line_no", F.substring(F.array_join(near, "\n"), 1, cut).alias("comment"))


def substantive_commits(commits: DataFrame, most: int = 30) -> DataFrame:
    """(repo, log): the newest commits that say something, as [date] message, joined."""
    good = (F.length("message") > 50) & ~F.lower("message").rlike("^(merge|update|fix typo|bump)")
    w = W.partitionBy("repo").orderBy(F.col("date").desc(), "sha")
    df = commits.where(good).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    line = F.concat(F.lit("["), F.substring(F.col("date").cast("string"), 1, 10), F.lit("] "), F.substring("message", 1, 500))
    rows = F.array_sort(F.collect_list(F.struct("n", line.alias("l"))))
    return df.groupBy("repo").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("log"))


def code_files(files: DataFrame, most: int = 50, largest: int = 100_000) -> DataFrame:
    """The files of each repository to read: examples after sources, tests last."""
    p = F.lower("path")
    rank = F.when(p.rlike("test|spec"), 3).when(p.rlike("example|demo"), 2).otherwise(1)
    w = W.partitionBy("repo").orderBy(rank, "path")
    return files.where(F.col("size") < largest).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def repository_of(sessions: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Sessions (.., cwd) with the repository whose checkout path is the longest that leads to cwd. A folder has few
    ancestors, so paths meet on equality."""
    parts = F.filter(F.split("cwd", "/"), lambda x: x != "")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    hits = sessions.select("session_id", F.explode(up).alias("path")).join(checkouts.select("path", "repo"), "path")
    best = hits.groupBy("session_id").agg(F.max_by("repo", F.length("path")).alias("repo"))
    return sessions.join(best, "session_id", "left")
