"""Line dedup: content-defined chunks of lines; stretches of chunks found before anywhere go after byte comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.llm.common import WORD, delete_stored, names_kept, quoted, stored

#: A line ends at a line feed, and at white space after a word that does not end in one of these letters. Such lines
#: hold two or three words, whatever stands before them: a passage may lie within one written line.
ON = "aehinorst"
LINE_END = rf"(?=[\x20\t\n\x0B\f\r])(?:(?<=[^\x20\t\n\x0B\f\r{ON}])|(?=\n))"
#: Where a word ends within a line; each word has the white space before it.
WORD_END = r"(?=[\x20\t\n\x0B\f\r])(?:(?<=[^\x20\t\n\x0B\f\r])|(?=\n))"
#: The white space of both.
SIGNS = " \t\n\x0b\x0c\r"
#: A chunk of CHUNK lines begins at the least rolling hash (over two lines) of every WINDOW successive ones, so any
#: WINDOW + CHUNK - 1 lines hold a whole chunk, whatever stands around them.
WINDOW, CHUNK = 8, 3
#: Lines compared beyond the last chunk of a stretch: were more than these equal, they would hold one chunk more.
AROUND = WINDOW + CHUNK
#: Words of a stretch that goes; shorter ones repeat by chance in a large corpus.
LEAST = 40
#: A place within a text and a number of words, in one number that orders by both.
UNIT = 1 << 31


def _lines(text: Column) -> Column:
    """The lines, each with the white space before it; joined, they are the text."""
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. Columns made one after another would copy the whole row each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row (k, t, s, g, h) for each chunk: its first line from 0, the lines to the next chunk (0: none), and a hash.
    Within a run of one line no chunk begins but at its head."""

    def marked(h: Column) -> Column:
        """The rolling hashes above their line numbers, so that a minimum tells its place; null after an equal line."""
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (CHUNK - 1), F.lit(0)))
        rolling = lambda x, i: F.shiftleft(F.xxhash64(x, F.get(h, i + 1)), 31) + i
        return F.transform(starts, lambda x, i: F.when(~x.eqNullSafe(F.get(h, i - 1)), rolling(x, i)))

    def least(m: Column, wide: int = 1) -> Column:
        """The places of the least of every window. A window further on has its least no earlier, so equal ones are
        neighbours and the places come in order."""
        if wide == WINDOW:
            return F.transform(F.filter(m, lambda x, i: x.isNotNull() & ~x.eqNullSafe(F.get(m, i - 1))), lambda x: x.bitwiseAND(UNIT - 1).cast("int"))
        step = min(wide, WINDOW - wide)
        return _let(F.zip_with(m, F.slice(m, F.lit(step + 1), F.size(m)), lambda x, y: F.least(x, y)), lambda w: least(w, wide + step))

    def chunks(h: Column, e: Column) -> Column:
        """Where a line ends is told by its own signs and the next one, so chunks of equal bytes are of equal lines."""
        return F.transform(e, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(e, i + 1) - s, F.lit(0)).alias("g"), F.xxhash64(*[F.get(h, s + j) for j in range(CHUNK)]).alias("h")))

    hashes = F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x))
    found = _let(hashes, lambda h: _let(_let(marked(h), lambda m: least(m)), lambda e: chunks(h, e)))
    return docs.select(F.col("__k").alias("k"), F.col("__t").alias("t"), F.explode(found).alias("c")).select("k", "t", "c.*")


def _body(line: Column, s: Column) -> Column:
    return F.array_join(F.slice(line, s + 1, F.lit(CHUNK)), "")


def _run(a: Column, b: Column) -> Column:
    """How many leading items of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def _words(line: Column) -> Column:
    return F.split(line, WORD_END)


def _bare(line: Column) -> Column:
    return F.transform(_words(line), lambda w: F.ltrim(w, F.lit(SIGNS)))


def _part(x: Column, y: Column, back: bool) -> Column:
    """How many words two lines have in common at the beginning, or at the end, but for the white space before them; 0 for
    null. Lines are taken apart only where their outermost signs, of white space any, are the same."""
    sign = (lambda a: F.translate(F.substring(a, -1, 1), SIGNS, " " * len(SIGNS))) if back else (lambda a: F.substring(F.ltrim(a, F.lit(SIGNS)), 1, 1))
    turn = F.reverse if back else (lambda a: a)
    return F.when(sign(x) == sign(y), _run(turn(_bare(x)), turn(_bare(y)))).otherwise(F.lit(0))


def _reach(values: Column, least: bool, by: int = 1) -> Column:
    """Each value of an array becomes the least from its place on, or the greatest up to it; of a sorted one it is that
    already. Those more than ``AROUND`` places away are no less, or no greater: every mark begins a line or more after the
    one before."""
    if by > AROUND:
        return values
    if by == 1:
        return _let(values, lambda v: F.when(F.sort_array(v) == v, v).otherwise(_reached(v, least, by)))
    return _reached(values, least, by)


def _reached(values: Column, least: bool, by: int) -> Column:
    best = F.least if least else F.greatest
    return _let(values, lambda v: _reach(F.transform(v, lambda x, i: best(x, F.get(v, i + by if least else i - by))), least, 2 * by))


@names_kept
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text`` but at their first place, by key and then place in the text;
    plus removed_lines and removed_chars.

    Chunks are matched by hash over the whole corpus; only chunks whose hash is found again travel with their bytes,
    from the hash's first place to the others, where they are compared. Between two chunks that follow each other at
    both places the lines are compared too, and at the ends of such a run lines and then words up to ``AROUND`` lines
    away, beyond which equal text would hold another chunk. Places that overlap or touch make a stretch; one of
    ``least`` words or more goes. Bytes are compared with their white space, but for that before a stretch's outermost words.

    Nothing of a hot chunk is gathered: its first place is a grouped minimum, its places an equi-join that adaptive
    execution splits. A text's work grows with its length. Documents of equal key and text are one document and
    cleaned alike; a null key comes first; null text stays null; an empty table gives an empty table. Result columns
    that ``docs`` has already are replaced; others may be of any type and name.
    """
    own = ["removed_lines", "removed_chars"]
    docs = docs.drop(*[c for c in own if c in docs.columns])
    docs = docs.withColumns({"__k": F.col(key), "__t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    places = stored(chunked(docs, text), "line-chunks")
    at = F.struct(F.col("k").isNotNull().alias("known"), "k", "t", "s", "g")
    again = stored(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "line-again")
    # Both tables are stored before they are joined, so that the joins have exchanges of their own and skew is split.
    found = stored(places.join(again.hint("shuffle_hash"), "h"), "line-found")
    delete_stored(places)
    firsts = stored(found.groupBy("h").agg(F.min(at).alias("o")), "line-firsts")
    twice = found.join(firsts.hint("shuffle_hash"), "h")
    itself = F.col("k").eqNullSafe(F.col("o.k")) & (F.col("t") == F.col("o.t")) & (F.col("s") == F.col("o.s"))
    # Equal where both parts are equal or null; of one type in all tables, so that joins keep the partitions.
    kind = f"struct<k:{docs.schema['__k'].dataType.simpleString()},t:bigint>"
    doc = lambda k, t: F.struct(F.col(k).alias("k"), F.col(t).alias("t")).cast(kind)
    marks = twice.groupBy(doc("k", "t").alias("d")).agg(F.sort_array(F.collect_set(F.struct("s", "g", "h", F.when(~itself, F.col("o")).alias("o")))).alias("r"))

    def follows(x: Column, y: Column) -> Column:
        a, b = x["o"], y["o"]
        same = a["k"].eqNullSafe(b["k"]) & (a["t"] == b["t"]) & (b["s"] == a["s"] + a["g"])
        return F.coalesce((y["s"] == x["s"] + x["g"]) & (x["g"] == a["g"]) & same, F.lit(False))

    ends = lambda x, i: F.struct(x["s"], x["g"], x["h"], x["o"], (~follows(F.get("r", i - 1), x)).alias("back"), (~follows(x, F.get("r", i + 1))).alias("forth"))
    marks = stored(marks.withColumn("r", F.transform("r", ends)), "line-marks")
    for old in (again, found, firsts):
        delete_stored(old)
    away = marks.select("d", F.explode(F.filter("r", lambda x: x["o"].isNotNull())).alias("x"))
    away = away.select("d", "x.*")
    # What a first place sends: its bytes, and the lines around them if a run ends there anywhere.
    sent = marks.select("d", F.explode(F.filter("r", lambda x: x["o"].isNull())).alias("x")).select("d", "x.s", "x.g", "x.h", F.lit(False).alias("back"), F.lit(False).alias("forth"))
    sent = sent.unionByName(away.where("back or forth").select(doc("o.k", "o.t").alias("d"), F.col("o.s").alias("s"), F.col("o.g").alias("g"), "h", "back", "forth"))
    sent = sent.groupBy("d", "s", "g", "h").agg(F.max("back").alias("back"), F.max("forth").alias("forth"))
    sent = sent.groupBy(F.col("d").alias("__w")).agg(F.collect_list(F.struct("s", "g", "h", "back", "forth")).alias("__r"))
    docs = docs.withColumn("__d", doc("__k", "__t"))
    others = [c for c in docs.columns if not c.startswith("__") and c != text]
    # Always true; it asks for the columns that the result needs, so that one shuffle of the texts serves both uses.
    same = F.xxhash64(*[quoted(c).isNull() for c in others], F.size("__r")) >= F.lit(-(2**63))
    asked = docs.join(sent.hint("shuffle_hash"), F.col("__d") == F.col("__w")).where(same)
    none = F.array().cast("array<string>")
    told = lambda line, x: F.struct(
        x["h"].alias("h"), _body(line, x["s"]).alias("body"), F.when(x["back"], _before(line, x["s"])).otherwise(none).alias("before"),
        F.slice(line, x["s"] + CHUNK + 1, F.when(x["forth"], F.lit(AROUND)).otherwise(F.greatest(x["g"] - CHUNK, F.lit(0)))).alias("after"),
    )
    said = _let(_lines(F.col(text)), lambda line: F.transform("__r", lambda x: told(line, x)))
    bodies = asked.select(F.explode(said).alias("p")).select("p.*").dropDuplicates(["h"])
    # On the complement of the hash, for the exchange of an aggregate could not be split.
    bodies = bodies.select(F.bitwise_not("h").alias("u"), "body", "before", "after")
    got = away.select(F.col("d").alias("__g"), "s", "g", F.bitwise_not("h").alias("u"), "back", "forth").join(bodies, "u")
    after = F.when(F.col("forth"), F.col("after")).otherwise(F.slice("after", F.lit(1), F.greatest(F.col("g") - CHUNK, F.lit(0))))
    got = got.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("s", "body", F.when(F.col("back"), F.col("before")).alias("before"), after.alias("after")))).alias("__p"))
    out = docs.join(got, F.col("__d") == F.col("__g"), "left")
    return _cut(out, text, least).select(*[quoted(c) for c in docs.columns if not c.startswith("__")], *own)


def _before(line: Column, s: Column) -> Column:
    return F.slice(line, F.greatest(s - AROUND, F.lit(0)) + 1, F.least(s, F.lit(AROUND)))


def _cut(out: DataFrame, text: str, least: int) -> DataFrame:
    """Cut from ``text`` what the first places' bytes in __p, sorted by line, say again."""
    first, pre = (lambda b: F.floor((b + (UNIT - 1)) / UNIT).cast("int")), (lambda b: F.pmod(-b, F.lit(UNIT)).cast("int"))
    last, post = (lambda e: F.shiftright(e, 31).cast("int")), (lambda e: e.bitwiseAND(UNIT - 1).cast("int"))
    piece = lambda line, a, b: F.array_join(F.slice(line, a + 1, F.greatest(b - a, F.lit(0))), "")

    def around(line: Column, marks: Column, p: Column, i: Column) -> Column:
        """The lines at a place, nearest first. Within a run, those before a chunk are the ones after the chunk that it
        follows."""
        before, none = F.coalesce(p["before"], F.get(marks, i - 1)["after"]), F.array().cast("array<string>")
        n = F.least(F.size(before), p["s"])
        back = F.when(n > 0, F.reverse(F.slice(line, p["s"] - n + 1, n))).otherwise(none)
        forth = F.when(F.size(p["after"]) > 0, F.slice(line, p["s"] + CHUNK + 1, F.size(p["after"]))).otherwise(none)
        return F.struct(p["s"].alias("s"), F.reverse(before).alias("before"), back.alias("back"), p["after"].alias("after"), forth.alias("forth"), (_body(line, p["s"]) == p["body"]).alias("same"))

    def ends(p: Column) -> Column:
        """How many lines are equal on both sides, and the lines that come next."""
        alike = lambda a, b: F.when(a == b, F.size(a)).otherwise(_run(a, b))
        runs = F.struct(alike(p["before"], p["back"]).alias("b"), alike(p["after"], p["forth"]).alias("f"))
        return _let(runs, lambda r: F.struct(
            p["s"].alias("s"), r["b"].alias("b"), r["f"].alias("f"), F.get(p["before"], r["b"]).alias("there_b"), F.get(p["back"], r["b"]).alias("here_b"),
            F.get(p["after"], r["f"]).alias("there_f"), F.get(p["forth"], r["f"]).alias("here_f"),
        ))

    def span(p: Column) -> Column:
        """(b, e): the first line less the words before it, and the last line plus the words after it, in UNITs."""
        top, end = p["s"].cast("long") - p["b"], p["s"].cast("long") + CHUNK - 1 + p["f"]
        return F.struct((top * UNIT - _part(p["there_b"], p["here_b"], True)).alias("b"), (end * UNIT + _part(p["there_f"], p["here_f"], False)).alias("e"))

    def stretches(line: Column, marks: Column) -> Column:
        """(first, pre, last, post) of the stretches that go: places that overlap or touch, put together."""

        def together(b: Column, e: Column) -> Column:
            opens = F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (first(x) > last(F.get(e, i - 1)) + 1), i)), lambda i: i.isNotNull())
            whole = lambda o, p, j: _let(F.struct(F.get(b, p).alias("b"), F.get(e, F.coalesce(F.get(o, j + 1), F.size(e)) - 1).alias("e")), lambda z: F.struct(
                first(z["b"]).alias("first"), pre(z["b"]).alias("pre"), last(z["e"]).alias("last"), post(z["e"]).alias("post")))
            return _let(opens, lambda o: F.transform(o, lambda p, j: whole(o, p, j)))

        held = F.filter(F.transform(marks, lambda p, i: around(line, marks, p, i)), lambda p: p["same"])
        spans = F.transform(F.transform(held, ends), span)
        bounds = lambda z: F.struct(_reach(F.transform(z, lambda x: x["b"]), True).alias("b"), _reach(F.transform(z, lambda x: x["e"]), False).alias("e"))
        count = lambda x, e: F.regexp_count(piece(line, x["first"], e), F.lit(WORD)) + x["pre"] + x["post"] >= least
        # A line has a word but for white space alone, so the first lines nearly always tell.
        long = lambda x: count(x, F.least(x["first"] + least, x["last"] + 1)) | ((x["last"] - x["first"] >= least) & count(x, x["last"] + 1))
        return F.filter(_let(_let(spans, bounds), lambda z: together(z["b"], z["e"])), long)

    def rest(line: Column, cuts: Column) -> Column:
        """The text without the stretches, and how many lines they were."""

        def gap(j: Column) -> Column:
            """What stands between the stretches j - 1 and j, less the words of its first and last line that go with either."""
            left, right = F.get(cuts, j - 1), F.get(cuts, j)
            a, b = F.coalesce(left["last"] + 1, F.lit(0)), F.coalesce(right["first"], F.size(line))
            head, tail = F.coalesce(left["post"], F.lit(0)), F.coalesce(right["pre"], F.lit(0))
            signs = lambda words: F.length(F.array_join(words, ""))
            top = F.when(head > 0, signs(F.slice(_words(F.get(line, a)), F.lit(1), head))).otherwise(F.lit(0))
            end = F.when(tail > 0, signs(F.slice(F.reverse(_words(F.get(line, b - 1))), F.lit(1), tail))).otherwise(F.lit(0))
            return F.struct(piece(line, a, b).alias("t"), top.alias("top"), end.alias("end"))

        bare = lambda g: F.substring(g["t"], g["top"] + 1, F.greatest(F.length(g["t"]) - g["top"] - g["end"], F.lit(0)))
        kept = F.transform(F.transform(F.sequence(F.lit(0), F.size(cuts)), gap), lambda g: F.when(g["top"] + g["end"] > 0, bare(g)).otherwise(g["t"]))
        gone = F.aggregate(cuts, F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
        return F.struct(F.array_join(kept, "").alias("t"), gone.alias("n"))

    def clean(line: Column) -> Column:
        return _let(stretches(line, F.col("__p")), lambda cuts: F.when(F.size(cuts) > 0, rest(line, cuts)))

    out = out.withColumn("__z", F.when(F.col("__p").isNotNull(), _let(_lines(F.col(text)), clean)))
    left = F.coalesce("__z.t", text)
    return out.withColumns({"removed_lines": F.coalesce("__z.n", F.lit(0)).cast("long"), "removed_chars": F.coalesce(F.when(F.col("__z").isNotNull(), F.length(text) - F.length("__z.t")), F.lit(0)).cast("long"), text: left})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
