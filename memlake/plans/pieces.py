"""Texts that hold other texts, met by their rarest pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pieces(text: Column, size: int = 3) -> Column:
    """The distinct runs of ``size`` signs of a text; none of a shorter one."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def rarest(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, piece): for each key of ``asked`` (key, piece) the one of its pieces that the fewest rows of ``held``
    (.., piece) hold, ties to the least; no row where one of them is held by none. Counts are of pieces, not of texts: as
    many rows as there are different pieces, and they are added up before they are shuffled."""
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    told = asked.join(counts, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = told.groupBy(key).agg(F.min(F.struct("n", "piece")).alias("m"))
    return least.where("m.n > 0").select(key, "m.piece")


def meetings(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, held): names of ``asked`` (name) of three signs or more and those of ``texts`` (name) that hold them."""
    mine = asked.select("name", F.explode(pieces(F.col("name"))).alias("piece"))
    held = texts.select(F.col("name").alias("held"), F.explode(pieces(F.col("name"))).alias("piece"))
    return held.join(rarest(mine, held, "name"), "piece").where("contains(held, name)").select("name", "held")
