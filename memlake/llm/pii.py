"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.llm.common import names_kept

#: Signs of an IBAN by country; fixed values.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "TL GI IQ IL OM SO AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HU LB NI PL",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIGNS.items())

#: (kind, pattern, score once confirmed, words nearby that raise it, words nearby that lower it). The first four are the base
#: kinds. Runs are taken whole and never given back, so a long text costs one pass: a start inside a run that failed
#: cannot match either.
KINDS: tuple[tuple[str, str, float, str, str], ...] = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"e-?mail|contact|mailto|correo|courriel", r"example|noreply"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"ip|address|host|server|adresse", r"version|release|chapter|section"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|credit|payment|karte|carte|tarjeta", r"isbn|order|serial"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|tel|call|mobile|fax|telefon", r"isbn|score"),
    ("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])", 0.9, r"iban|bank|account|konto|compte|cuenta", r"part|model"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security|tax", r"part|model|date"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", 0.9, r"aws|key|access", r"example"),
    ("secret", r"(?i)(?<![a-z0-9])(?:api[_-]?key|token|secret|password|passwd)[\x20\"']{0,3}[:=][\x20\"']{0,3}[A-Za-z0-9_/+.=-]{12,}+", 0.8, r"secret|auth|login|token|key", r"example|placeholder"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters of context on each side, and the least score of a span that the method adds.
CONTEXT, LEAST = 40, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """The remainder of an IBAN read as a number, letters as 10 to 35, its first four signs moved to the end."""
    s = F.regexp_replace(m, " ", "")
    moved = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), lambda a, c: step(a, c).cast("int"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (_mod97(m) == 1)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}


@names_kept
def spans(docs: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """``docs`` plus ``spans``: an array of (kind, start, end, score), by kind as listed, then start.

    Starts follow from the pieces between matches, whose lengths a running sum adds up: code points, end exclusive.
    Matches are the leftmost that do not overlap, of each kind; those that a checksum or bound rejects go, without a
    retry. A span of a base kind stays whatever its score; others need ``LEAST``. Null text counts as empty and has
    no spans. Everything is in the row: no shuffle, and repeated rows each get their own result.
    """
    df = docs.drop(*[c for c in ("spans",) if c in docs.columns]).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    parts = []
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    for kind, rx, score, more, less in kinds:
        m, at = f"__m_{kind}", f"__a_{kind}"
        hit = F.col("__t").contains(HINTS[kind]) if kind in HINTS else F.lit(True)
        df = df.withColumn(m, F.when(hit, F.regexp_extract_all("__t", F.lit(rx), F.lit(0))))
        some = F.size(m) > 0
        gaps = F.when(some, F.transform(F.split("__t", rx), lambda g: F.length(g)))
        df = df.withColumn(at, gaps)
        step = lambda acc, x: F.struct((acc["p"] + x["g"] + F.length(x["m"])).alias("p"), F.array_append(acc["s"], acc["p"] + x["g"]).alias("s"))
        zipped = F.zip_with(at, m, lambda g, x: F.struct(g.alias("g"), F.coalesce(x, F.lit("")).alias("m")))
        starts = F.aggregate(zipped, F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("s")), step, lambda acc: acc["s"])
        df = df.withColumn(at, F.when(some, starts))
        parts.append(_confirmed(kind, m, at, score, more, less))
    df = df.withColumn("spans", F.concat(*[F.coalesce(p, none) for p in parts]))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _confirmed(kind: str, m: str, at: str, score: float, more: str, less: str) -> Column:
    both = F.filter(F.zip_with(m, at, lambda x, a: F.struct(x.alias("m"), a.alias("a"))), lambda x: x["m"].isNotNull())

    def scored(x: Column) -> Column:
        first = F.greatest(x["a"] - CONTEXT, F.lit(0))
        after = x["a"] + F.length(x["m"])
        near = F.concat(F.substr(F.col("__t"), first + 1, x["a"] - first), F.lit(" "), F.substr(F.col("__t"), after + 1, F.lit(CONTEXT)))
        rated = F.lit(score) + F.when(near.rlike(rf"(?i)\b(?:{more})\b"), 0.3).otherwise(0.0) - F.when(near.rlike(rf"(?i)\b(?:{less})\b"), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["a"].cast("long").alias("start"), (x["a"] + F.length(x["m"])).cast("long").alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rated)).alias("score"))

    found = F.transform(F.filter(both, lambda x: _valid(kind, x["m"])), scored)
    return found if kind in BASE_KINDS else F.filter(found, lambda s: s["score"] >= LEAST)


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return df.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_told(of(*BASE_KINDS)), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE_KINDS))).cast("long").alias("n_other"), F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 3).alias("top_score"),
    )
