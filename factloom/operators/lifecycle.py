"""Forgetting and the maintenance run over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import communities, consolidate
from factloom.operators.mentions import recount_mentions
from factloom.operators.profile import profile_facts
from factloom.session import cut

#: Columns of a memory that no maintenance step reads, besides the text.
UNREAD = ["summary", "tags", "metadata"]
NOISE_CONFIDENCE = 0.3
NOISE_DAYS = 7
EPISODIC_DAYS = 90


def _before(now, days: int):
    return F.col("created_at") < X.at(now) - F.make_dt_interval(F.lit(days))


def expired(memories: DataFrame, now) -> DataFrame:
    """Live memories whose validity has ended."""
    return memories.filter(F.col("is_latest") & (F.col("valid_until") < X.at(now))).select("entity_id", "id", F.lit("expired").alias("reason"))


def noise(memories: DataFrame, now) -> DataFrame:
    """Live memories of low confidence older than a week."""
    return memories.filter(F.col("is_latest") & (F.col("confidence") < NOISE_CONFIDENCE) & _before(now, NOISE_DAYS)).select("entity_id", "id", F.lit("noise_filtered").alias("reason"))


def faded_episodes(memories: DataFrame, now) -> DataFrame:
    """Live episodic memories older than 90 days."""
    return memories.filter(F.col("is_latest") & (F.col("memory_type") == "episodic") & _before(now, EPISODIC_DAYS)).select("entity_id", "id", F.lit("episodic_decay").alias("reason"))


@dataclass
class MemoryBase:
    """The tables one maintenance run reads and rewrites."""

    memories: DataFrame
    edges: DataFrame
    mention_edges: DataFrame
    mentions: DataFrame
    embeddings: DataFrame


def _marked(memories: DataFrame, targets: DataFrame, now) -> DataFrame:
    side = targets.groupBy("entity_id", "id").agg(F.min("reason").alias("_reason"))
    rows = memories.join(side, ["entity_id", "id"], "left")
    hit = F.col("_reason").isNotNull()
    return rows.withColumns({
        "is_latest": F.col("is_latest") & ~hit, "expired_at": F.when(hit, X.at(now)).otherwise(F.col("expired_at")),
        "replaced_by": F.when(hit, F.col("_reason")).otherwise(F.col("replaced_by")), "updated_at": F.when(hit, X.at(now)).otherwise(F.col("updated_at")),
    }).select(*memories.columns)


def mark_expired(base: MemoryBase, targets: DataFrame, now) -> MemoryBase:
    """Retire the targets softly, drop their mentions, recount and prune nodes.

    Content and other edges stay. ``targets`` has (entity_id, id, reason).
    """
    memories = _marked(base.memories, targets, now)
    side = targets.select("entity_id", "id").distinct()
    left = base.mention_edges.join(side.select("entity_id", F.col("id").alias("memory_id")), ["entity_id", "memory_id"], "left_anti")
    return MemoryBase(memories, base.edges, left, recount_mentions(base.mentions, left), base.embeddings)


def forget_communities(base: MemoryBase, now) -> tuple[DataFrame, DataFrame]:
    """Verdict per community, and the members to forget."""
    facts = profile_facts(base.memories, base.edges, now)
    members = cut(communities.community_members(base.memories, base.edges, base.mention_edges, facts))
    decided = cut(communities.verdicts(communities.scores(members, now)))
    gone = communities.forgotten_members(members, decided).withColumn("reason", F.lit("community_forgotten"))
    return decided, gone


def consolidate_duplicates(base: MemoryBase, now, similarity: float = consolidate.SIMILARITY, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdict per candidate pair, and the merges to land.

    With ``texts`` (entity_id, id, content), memories hold digests for their
    contents, and only texts of close pairs are read.
    """
    facts = profile_facts(base.memories, base.edges, now)
    pairs = cut(consolidate.candidate_pairs(base.memories, base.embeddings, now, similarity, base.edges, facts))
    read = base.memories
    if texts is not None:
        ends = cut(pairs.select("entity_id", F.explode(F.array("a", "b")).alias("id")).distinct())
        read = read.drop("content").join(texts.join(ends, ["entity_id", "id"], "left_semi"), ["entity_id", "id"])
    judged = cut(consolidate.judge_pairs(pairs, read, base.edges, facts, now))
    return judged, cut(consolidate.merges(judged, consolidate.representatives(judged)))


def land_merges(base: MemoryBase, merged: DataFrame, now) -> MemoryBase:
    """Merged memories retired, relations and mentions moved to their representatives."""
    mention_edges = consolidate.rewrite_mentions(base.mention_edges, merged)
    return MemoryBase(
        consolidate.retire_merged(base.memories, merged, now), consolidate.rewrite_relations(base.edges, merged), mention_edges,
        recount_mentions(base.mentions, mention_edges), base.embeddings,
    )


def _materialise(base: MemoryBase) -> MemoryBase:
    return MemoryBase(cut(base.memories), base.edges, cut(base.mention_edges), cut(base.mentions), base.embeddings)


def maintain(base: MemoryBase, now) -> tuple[MemoryBase, DataFrame]:
    """One maintenance run: expiry, noise, decay, communities, consolidation.

    The three simple strategies see what the earlier ones left and need one
    rewrite together. Between the steps memories go without their texts, which
    digests stand for; whole memories are rewritten once, at the end. Returns
    the new tables and (strategy, action, n).
    """
    whole, texts = base.memories, base.memories.select("entity_id", "id", "content")
    steps = expired(base.memories, now)
    steps = steps.unionByName(noise(base.memories, now).join(steps, ["entity_id", "id"], "left_anti"))
    steps = steps.unionByName(faded_episodes(base.memories, now).join(steps, ["entity_id", "id"], "left_anti"))
    steps = cut(steps)
    report = steps.groupBy(F.col("reason").alias("strategy")).agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.lit("forgotten"))
    # Digested in the scan: the optimizer would leave it until after the joins.
    light = cut(base.memories.drop(*UNREAD).withColumn("content", F.sha2("content", 256)))
    base = MemoryBase(light, base.edges, base.mention_edges, base.mentions, base.embeddings)
    base = _materialise(mark_expired(base, steps, now))
    decided, gone = forget_communities(base, now)
    gone = cut(gone)
    report = report.unionByName(decided.groupBy("action").agg(F.count(F.lit(1)).alias("n")).withColumn("strategy", F.lit("communities")))
    base = _materialise(mark_expired(base, gone, now))
    judged, merged = consolidate_duplicates(base, now, texts=texts)
    report = report.unionByName(judged.groupBy("action").agg(F.count(F.lit(1)).alias("n")).withColumn("strategy", F.lit("duplicates")))
    report = report.unionByName(merged.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicates").alias("strategy"), F.lit("merged").alias("action"), "n"))
    base.memories = _marked(_marked(whole, steps, now), gone, now)
    base = land_merges(base, merged, now)
    return MemoryBase(cut(base.memories), cut(base.edges), cut(base.mention_edges), cut(base.mentions), base.embeddings), report.select("strategy", "action", "n")


def archive_fast_lane(fast_lane: DataFrame, now, indexed: DataFrame | None = None, max_age_hours: int = 24) -> DataFrame:
    """Archive live fast-lane rows that are a day old or whose text is indexed."""
    cutoff = X.at(now) - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    rows = fast_lane
    done = F.lit(False)
    if indexed is not None:
        rows = rows.join(indexed.select("id", F.lit(True).alias("_done")).distinct(), "id", "left")
        done = F.coalesce("_done", F.lit(False))
    gone = (F.col("stage") == "fast_lane") & (done | (F.col("created_at") <= cutoff))
    return rows.withColumns({"archived_at": F.when(gone, X.at(now)).otherwise(F.col("archived_at")), "stage": F.when(gone, "archived").otherwise(F.col("stage"))}).select(*fast_lane.columns)
