"""Evaluation of retrieval, classification, supersession and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _share(condition) -> F.Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """precision@1, recall@3, recall@5 and MRR over all expected queries.

    ``ranked`` has (query_id, id, rank), ``expected`` (query_id, id). A query
    counts by its best-ranked expected hit; without a hit it counts as zero.
    """
    hits = ranked.join(expected.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    rows = expected.select("query_id").distinct().join(hits, "query_id", "left")
    at = lambda n: _share(F.coalesce(F.col("best") <= n, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), at(1).alias("precision_1"), at(3).alias("recall_3"), at(5).alias("recall_5"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))).alias("mrr"),
    )


def classification_report(rows: DataFrame) -> DataFrame:
    """Per expected class: cases, correct ones, accuracy. Needs (expected, predicted)."""
    right = F.col("expected").eqNullSafe(F.col("predicted"))
    return rows.groupBy("expected").agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(right, 1)).alias("correct"), _share(right).alias("accuracy"))


def supersession_audit(chains: DataFrame, memories: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """How well chains of versions were superseded and what retrieval returns.

    ``chains`` has (entity_id, chain, step, id), steps counting from 0;
    ``ranked`` (id, hit, rank) the results of asking for each step's text.
    """
    nxt = chains.select("entity_id", "chain", (F.col("step") - 1).alias("step"), F.col("id").alias("next_id"))
    rows = chains.join(nxt, ["entity_id", "chain", "step"], "left").join(memories.select("entity_id", "id", "is_latest", "replaced_by"), ["entity_id", "id"])
    direct = edges.filter("rel_type = 'UPDATES'").select("entity_id", F.col("to_id").alias("id"), F.col("from_id").alias("next_id"), F.lit(True).alias("linked")).distinct()
    rows = rows.join(direct, ["entity_id", "id", "next_id"], "left")
    own = ranked.filter("hit = id").groupBy("id").agg(F.min("rank").alias("own_rank"))
    rows = rows.join(own, "id", "left")
    old, last = F.col("next_id").isNotNull(), F.col("next_id").isNull()
    flipped = ~F.col("is_latest") & (F.col("replaced_by") == F.col("next_id"))
    rate = lambda test, of: F.avg(F.when(of, F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)))
    return rows.agg(
        F.count(F.when(old, 1)).alias("rounds"), rate(flipped, old).alias("flip_rate"), rate(F.col("linked"), old).alias("edge_rate"),
        rate(F.col("own_rank") == 1, last).alias("final_recall"), rate(F.col("own_rank").isNull(), old).alias("expired_exclusion"),
    )


def profile_coverage(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of expected memories found in the profile, per entity."""
    held = facts.select("entity_id", F.col("memory_id").alias("id"), F.lit(True).alias("_held")).distinct()
    rows = expected.join(held, ["entity_id", "id"], "left")
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("expected"), _share(F.coalesce("_held", F.lit(False))).alias("coverage"))


def forgetting_rates(expected: DataFrame, memories: DataFrame) -> DataFrame:
    """Keep rate of what must stay and forget rate of what must go. Needs (id, keep)."""
    rows = expected.join(memories.select("id", "is_latest"), "id")
    return rows.agg(F.avg(F.when(F.col("keep"), F.col("is_latest").cast("double"))).alias("keep_rate"), F.avg(F.when(~F.col("keep"), (~F.col("is_latest")).cast("double"))).alias("forget_rate"))


def gate_report(report: DataFrame, baseline: DataFrame, chain: str, average: float = 0.7, chain_score: float = 0.8) -> DataFrame:
    """Release gate (no dimension below its baseline) and pass gate in one row.

    A dimension that only one side has fails the release gate.
    """
    rows = report.select("dimension", "score").join(baseline.select("dimension", F.col("score").alias("base")), "dimension", "full")
    return rows.agg(
        F.bool_and(F.coalesce(F.col("score") >= F.col("base"), F.lit(False))).alias("release_passed"),
        F.avg("score").alias("average"),
        (F.coalesce(F.max(F.when(F.col("dimension") == chain, F.col("score"))) >= chain_score, F.lit(False)) & (F.avg("score") >= average - 1e-9)).alias("pass_gate"),
    )
