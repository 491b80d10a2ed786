"""The batch run: exported nodes to a merged store and its index, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from memlake.operators import filters, hooks, lifecycle, merge, parse, upkeep
from memlake.plans.tables import stored


def linearized(nodes: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) along the primary path of each conversation."""
    path = parse.primary_messages(parse.tour(nodes))
    return parse.messages(path.join(nodes.select("conv_id", "id", "role", "text"), ["conv_id", "id"]).select("conv_id", "turn", "role", "text"))


def run(nodes: DataFrame, processed: DataFrame, store: DataFrame, extractor: Callable[[str], str], to_entries: Callable[[DataFrame], DataFrame], now, price: tuple[float, float] = (0.0, 0.0)) -> dict[str, DataFrame]:
    """Parse, drop what is processed, filter, prompt, extract, merge, index. ``to_entries`` makes entries of the answers
    (conv_id, prompt, answer); each stage is stored, so later ones repeat no model call.

    The report is one row of what the stages counted as they were written, so none is read again for it: parsed and kept
    conversations, answers and those that failed (null), estimated tokens in and out and their cost at ``price`` a
    million, entries by action."""
    seen = {name: Observation(f"distill-{name}") for name in ("scores", "answers", "extracted", "log")}
    count = lambda condition, name: F.count_if(condition).alias(name)
    turns = stored(linearized(nodes), "turns")
    fresh = upkeep.unprocessed(turns, processed, "conv_id")
    scores = stored(filters.scored(fresh).observe(seen["scores"], F.count(F.lit(1)).alias("parsed"), count(F.col("decision") == "keep", "kept")), "scores")
    kept = fresh.join(scores.where("decision = 'keep'").select("conv_id"), "conv_id", "left_semi")
    said = lambda c: F.coalesce(F.sum(parse.token_estimate(F.col(c))), F.lit(0).cast("long"))
    answers = hooks.extract(parse.prompt(kept), extractor)
    answers = stored(answers.observe(seen["answers"], F.count(F.lit(1)).alias("answers"), count(F.col("answer").isNull(), "failed"), said("prompt").alias("tokens_in"), said("answer").alias("tokens_out")), "answers")
    new = stored(to_entries(answers).observe(seen["extracted"], F.count(F.lit(1)).alias("extracted")), "extracted")
    log = merge.merge_log(new, merge.matches(new, store))
    log = stored(log.observe(seen["log"], *[count(F.col("action") == a, a) for a in ("create", "update", "evolve", "contest")]), "merge-log")
    after = stored(merge.applied(store, new, log), "merged")
    told = {name: value for observation in seen.values() for name, value in observation.get.items()}
    told["cost"] = (told["tokens_in"] * price[0] + told["tokens_out"] * price[1]) / 1e6
    schema = ", ".join(f"{name} {'double' if name == 'cost' else 'long'}" for name in told)
    report = nodes.sparkSession.createDataFrame([tuple(told.values())], schema)
    return {"entries": after, "log": log, "scores": scores, "processed": scores.select("conv_id"), "report": report.withColumn("run_at", F.lit(now).cast("timestamp"))}
