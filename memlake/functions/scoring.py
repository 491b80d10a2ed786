"""Scalar scoring over columns: tiers, salience, recency, final score, comparable text. ``now`` is always a parameter."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from memlake import policy as P


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def look_up(table: dict, key: Column, default) -> Column:
    """The value of a small fixed table; ``default`` where it has no such key."""
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items() if v is not None))
    return F.coalesce(F.create_map(*pairs)[key], as_column(default))


def half_up(x: Column, digits: int = 4) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def days_between(earlier: Column, later: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6)


def tier_of(context_type: Column) -> Column:
    return look_up(P.TIERS, context_type, 3)


def stored_tier(tier: Column, context_type: Column) -> Column:
    """A stored tier of 1 to 3, else that of the context type."""
    return F.when(tier.isin(1, 2, 3), tier.cast("int")).otherwise(tier_of(context_type))


def search_tier(tier: Column, similarity: Column) -> Column:
    return F.when((tier == 2) & (similarity < P.TIER_2_SIMILARITY), 3).otherwise(tier)


def decay(context_type: Column, last_seen: Column, now: Column) -> Column:
    finite = context_type.isin(*[k for k, v in P.HALF_LIVES.items() if v is None])
    life = look_up(P.HALF_LIVES, context_type, P.HALF_LIVES[P.DEFAULT_TYPE])
    return F.when(F.coalesce(finite, F.lit(False)), 1.0).otherwise(F.pow(F.lit(0.5), days_between(F.coalesce(last_seen, now), now) / life))


def salience(confidence: Column, context_type: Column, mentions: Column, last_seen: Column, last_accessed: Column, now) -> Column:
    """min(1, confidence x decay x multiplier x frequency + boost of the last access), to 4 places."""
    now = as_column(now)
    sure = look_up(P.CONFIDENCE, confidence, P.CONFIDENCE["medium"])
    weight = look_up(P.MULTIPLIERS, context_type, P.MULTIPLIERS[P.DEFAULT_TYPE])
    often = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(1), F.coalesce(mentions, F.lit(1)))) / F.log1p(F.lit(P.FULL_MENTIONS)))
    boost = F.when(last_accessed.isNotNull(), P.ACCESS_BOOST * F.pow(F.lit(0.5), days_between(last_accessed, now) / P.ACCESS_HALF_LIFE)).otherwise(0.0)
    return half_up(F.least(F.lit(1.0), sure * decay(context_type, last_seen, now) * weight * often + boost))


def recency(updated: Column, now) -> Column:
    days = (F.unix_micros(as_column(now)) - F.unix_micros(updated)) / 86400e6
    out = F.when(updated.isNull(), P.RECENCY_UNKNOWN)
    for most, score in P.RECENCY_STEPS:
        out = out.when(days <= most, score)
    return out.otherwise(P.RECENCY_OLD)


def source_weight(weights: Column, source: Column | None = None, fall_back: bool = False) -> Column:
    """At least 1 where a map of weights is there, even an empty one (``fall_back``: only a filled one); else by words
    of the source."""
    known = F.aggregate(F.map_keys(weights), F.lit(1.0), lambda a, k: F.greatest(a, look_up(P.SOURCE_WEIGHTS, k, 1.0)))
    if source is None:
        return F.coalesce(known, F.lit(1.0))
    s = F.lower(F.coalesce(source, F.lit("")))
    named = F.when(s.rlike("gmail|email|mbox"), P.SOURCE_WEIGHTS["email"]).when(s.contains("readme"), P.SOURCE_WEIGHTS["github_readme"]).when(s.rlike("github|repo"), P.SOURCE_WEIGHTS["github_commits"]).otherwise(1.0)
    use = (F.size(weights) > 0) if fall_back else weights.isNotNull()
    return F.when(use, known).otherwise(named)


def final_score(similarity: Column, recent: Column, salient: Column, tier: Column, weight: Column) -> Column:
    base = P.SEMANTIC * similarity + P.RECENCY * recent + P.SALIENCE * salient
    return half_up(base * look_up(P.TIER_MULTIPLIERS, tier, 1.0) * weight)


def comparable(text: Column) -> Column:
    """Lower case, other than a-z and 0-9 to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(comparable(text), " "), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def opposing(a: Column, b: Column, whole_words: bool = False) -> Column:
    """The first pair of opposing markers that two comparable texts hold on different sides, or null."""
    has = (lambda t, m: F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {m} ")) if whole_words else (lambda t, m: t.contains(m))
    return F.coalesce(*[F.when((has(a, p) & has(b, n)) | (has(a, n) & has(b, p)), F.lit(f"opposing markers ({p} vs {n})")) for p, n in P.OPPOSING])


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` signs, the last three dots where something is cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def parsed_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def extreme_time(texts: Column, latest: bool) -> Column:
    """Of an array of time strings the earliest or latest by parsed time, as written; invalid ones are passed over."""
    known = F.filter(F.transform(texts, lambda t: F.struct(F.try_to_timestamp(t).alias("t"), t.alias("raw"))), lambda s: s["t"].isNotNull())
    return (F.array_max if latest else F.array_min)(known)["raw"]


def to_int(text: Column, default: int = 0, truncate: bool = True) -> Column:
    """A lenient integer: of a fractional number the whole part, or with ``truncate`` off the default."""
    whole = text.try_cast("bigint") if not truncate else text.try_cast("double").try_cast("bigint")
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), whole) if not truncate else whole, F.lit(default))


def note(at: Column, source: Column, action: Column, detail: Column) -> Column:
    return F.concat_ws(" | ", at, F.concat(F.lit("source="), source), F.concat(F.lit("action="), action), F.concat(F.lit("detail="), detail))


def appended(items: Column, item: Column, most: int) -> Column:
    """A bounded log: the item is added unless it equals the last, and the newest ``most`` stay."""
    old = F.coalesce(items, F.array().cast("array<string>"))
    new = F.when(F.coalesce(F.try_element_at(old, F.lit(-1)) == item, F.lit(False)), old).otherwise(F.array_append(old, item))
    return F.slice(new, F.greatest(F.size(new) - (most - 1), F.lit(1)), F.lit(most))


def filled(items: Column) -> Column:
    """Distinct items that are not empty, in order of first sight."""
    return F.array_distinct(F.filter(items, lambda v: v.isNotNull() & (v != "")))


def conversation_fingerprint(conv_id: Column, title: Column, updated: Column, messages: Column) -> Column:
    """First 16 hex digits of SHA-256 over id, title, count, last change and the first 100 signs of every message."""
    heads = F.transform(messages, lambda m: F.struct(m["id"].alias("id"), F.substring(m["content"], 1, 100).alias("head")))
    return F.substring(F.sha2(F.to_json(F.struct(conv_id.alias("id"), title.alias("title"), F.size(messages).alias("count"), updated.alias("updated"), heads.alias("messages"))), 256), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of one length; 0 if either has no length in space."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
