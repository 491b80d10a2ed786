"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.llm.common import SPACE, names_kept

#: Function words of the four languages, as lower-case words.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "as", "with", "at", "by", "be", "this", "was", "are",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "est",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "es",
)

#: Letters of those languages, and what is counted among the signs that are no white space.
LATIN = r"\p{IsLatin}"

#: (rule, measure, what it is divided by, a document fails when the ratio is ..., threshold); measures are columns of
#: ``measured``. A ratio over nothing passes.
RULES: tuple[tuple[str, str, str | None, str, float], ...] = (
    ("few_words", "n_words", None, "<", 20),
    ("repeat_words", "n_repeat_words", "n_words", ">", 0.3),
    ("symbols", "n_symbols", "n_words", ">", 0.5),
    ("short_words", "word_chars", "n_words", "<", 2),
    ("long_words", "word_chars", "n_words", ">", 20),
    ("dup_lines", "n_dup_lines", "n_lines", ">", 0.5),
    ("bullets", "n_pipes", "n_words", ">", 0.2),
    ("shouting", "n_upper", "word_chars", ">", 0.5),
    ("exclaims", "n_exclaims", "n_words", ">", 0.5),
    ("stop_words", "n_stop_words", "n_stop_base", "<", 0.01),
    ("stutter", "n_stutter", "n_words", ">", 0.5),
)


@names_kept
def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every whole text. Word windows are compared by 64-bit hashes within one text.

    ``n_stop_base`` are the words among which function words are expected: all, but none in a text in which Latin letters
    are fewer than half of what is no white space, for the function words are of languages written in them. The letters
    are counted only where function words are few.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipes", "n_upper", "n_exclaims", "n_stop_words", "n_stop_base", "n_stutter"]
    clash = [c for c in docs.columns if c in own]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.drop(*clash).withColumn("__t", body).withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("__w") >= 9, F.transform(F.sequence(F.lit(1), F.size("__w") - 7), lambda i: F.xxhash64(F.slice("__w", i, 8))))
    df = df.withColumns({"__h": windows, "__l": lines})
    repeated = F.size("__h") > F.size(F.array_distinct("__h"))
    df = df.withColumn("__s", F.when(repeated, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("__s", lambda x, k: (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"]))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.transform(twin, lambda x: x["i"]))))
    steps = F.transform("__p", lambda x, k: F.least(F.lit(8), F.coalesce(F.get("__p", k + 1) - x, F.lit(8))))
    size = lambda c: F.size(c).cast("long")
    left = lambda rx: (F.length("__t") - F.length(F.regexp_replace("__t", rx, ""))).cast("long")
    df = df.withColumns({
        "n_words": size("__w"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": left(r"[#*$%&|<>]"),
        "n_dup_lines": size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "n_lines": size("__l"),
        "n_pipes": left(r"\|"),
        "n_upper": left(r"\p{Lu}"),
        "n_exclaims": left("!!"),
        "n_stop_words": size(F.filter("__w", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_stutter": size(F.filter("__w", lambda w, i: w == F.get("__w", i - 1))),
    })
    latin = (F.length("__t") - F.length(F.regexp_replace("__t", LATIN, ""))).cast("long")
    df = df.withColumn("n_stop_base", F.when(100 * F.col("n_stop_words") >= F.col("n_words"), F.col("n_words")).when(2 * latin >= F.col("word_chars"), F.col("n_words")).otherwise(F.lit(0).cast("long")))
    return df.drop("__t", "__w", "__h", "__l", "__s", "__p")


def failing(rules=RULES) -> dict[str, Column]:
    """One boolean column for each rule: whether the document fails it."""
    out = {}
    for name, what, over, sign, t in rules:
        ratio = F.try_divide(F.col(what), F.col(over)) if over else F.col(what)
        out[f"fails_{name}"] = F.coalesce(ratio < t if sign == "<" else ratio > t, F.lit(False))
    return out


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, a ``fails_...`` column a rule, ``base_failed`` and ``kept``.

    A null text counts as empty and fails (fewer than 20 words); repeated rows each get their own verdict; an empty
    table gives an empty table; columns of ``docs`` named like a measure are replaced by it.
    """
    df = measured(docs, text)
    flags = failing(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.drop(*[c for c in df.columns if c in flags or c in ("base_failed", "kept")]).withColumns(flags).withColumn("base_failed", base)
    any_failed = F.col("base_failed")
    for c in flags:
        any_failed = any_failed | F.col(c)
    return df.withColumn("kept", ~any_failed)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = apply_rules(docs)
    failed = F.array_join(F.filter(F.array(*[F.when(F.col(c), F.lit(c[6:])) for c in failing()]), lambda x: x.isNotNull()), ",")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", failed.alias("failed_rules"))


def _rules_sql() -> str:
    tests = ", ".join(f"CASE WHEN {what}{f'::DOUBLE / nullif({over}, 0)' if over else ''} {sign} {t} THEN '{name}' END" for name, what, over, sign, t in RULES)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


_LEFT = "length(t) - length(regexp_replace(t, '{}', '', 'g'))"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(n - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_LEFT.format('[#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines, {_LEFT.format('[|]')} AS n_pipes, {_LEFT.format('[[:upper:]]').replace('[[:upper:]]', chr(92) + 'p{Lu}')} AS n_upper, {_LEFT.format('!!')} AS n_exclaims,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
  CASE WHEN 2 * ({_LEFT.format('[[:latin:]]').replace('[[:latin:]]', chr(92) + 'p{Latin}')}) >= length(array_to_string(w, '')) THEN len(w) ELSE 0 END AS n_stop_base,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter
  FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_rules_sql()} AS f FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND len(f) = 0 AS kept, array_to_string(f, ',') AS failed_rules FROM r
"""
