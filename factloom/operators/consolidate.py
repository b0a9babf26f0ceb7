"""Lossless consolidation of near-duplicate memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import relate
from factloom.operators.communities import protection
from factloom.operators.graph import components
from factloom.operators.scans import top_per
from factloom.operators.vectors import near_pairs
from factloom.session import cut

SIMILARITY = 0.9


def guard_classes(memories: DataFrame, embeddings: DataFrame, now, edges: DataFrame | None = None, facts: DataFrame | None = None, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Live memories by class, and near vectors.

    Members of a class agree in all that a verdict reads: vector, type, text and
    protection; a memory with an UPDATES edge to a close one is a class of its
    own. So a class has one verdict against any other and one within. Returns
    (entity_id, id, vector, class, head), head being the member that would stand
    for the class (most trusted, newest, smallest id), and (entity_id, vector,
    other, score) of close vectors, each with itself included.
    """
    live = memories.filter("is_latest").select("entity_id", "id", "memory_type", "created_at", "content", X.trust(now).alias("trust"))
    live = protection(live, facts) if facts is not None else live.withColumn("protected", F.lit(False))
    vectors = embeddings.filter(F.col("document_id").isNull()).select("entity_id", F.col("chunk_id").alias("id"), "embedding")
    rows = cut(live.join(vectors, ["entity_id", "id"]).withColumn("vector", F.sha2(F.to_json("embedding"), 256)).withColumn("text", F.sha2("content", 256)).drop("content"))
    distinct = rows.groupBy("entity_id", F.col("vector").alias("vid")).agg(F.first("embedding").alias("vec"))
    pairs = near_pairs(distinct, similarity)
    there = pairs.select("entity_id", F.col("a").alias("vector"), F.col("b").alias("other"), "score")
    back = pairs.select("entity_id", F.col("b").alias("vector"), F.col("a").alias("other"), "score")
    # Zero vectors are close to nothing else; copies are close by being equal.
    same = distinct.select("entity_id", F.col("vid").alias("vector"), F.col("vid").alias("other"), F.lit(1.0).alias("score"))
    near = cut(there.unionByName(back).unionByName(same))
    if edges is not None:
        ends = edges.filter("rel_type = 'UPDATES' AND from_id <> to_id").select("entity_id", "from_id", "to_id")
        at = lambda end, v: rows.select("entity_id", F.col("id").alias(end), F.col("vector").alias(v))
        close = ends.join(at("from_id", "vector"), ["entity_id", "from_id"]).join(at("to_id", "other"), ["entity_id", "to_id"]).join(near, ["entity_id", "vector", "other"], "left_semi")
        linked = close.select("entity_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        rows = rows.join(linked.withColumn("own", F.col("id")), ["entity_id", "id"], "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("string"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("vector", "memory_type", "protected", "text", "own")]
    rows = rows.withColumn("class", F.sha2(F.concat_ws("\x1f", *parts), 256))
    first = F.struct((-F.col("trust")).alias("t"), F.coalesce(-F.unix_micros("created_at"), F.lit(1 << 62)).alias("c"), F.col("id").alias("id"))
    heads = rows.groupBy("entity_id", "class").agg(F.min(first)["id"].alias("head"))
    return cut(rows.select("entity_id", "id", "vector", "class").join(heads, ["entity_id", "class"])), near


def class_pairs(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (entity_id, a, b, similarity), a < b, of every memory with the heads of its own and of each near class.

    Any number of copies costs their count and not their pairs. As a class has
    one verdict, these pairs connect what all pairs connect; and whoever stands
    for a merged group is the head of its class, so it has a pair with every member close to it.
    """
    heads = classes.select("entity_id", F.col("vector").alias("other"), "head").distinct()
    met = classes.select("entity_id", "vector", "id").join(near, ["entity_id", "vector"]).join(heads, ["entity_id", "other"]).filter("id <> head")
    return met.groupBy("entity_id", F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).agg(F.max("score").alias("similarity"))


def candidate_pairs(memories: DataFrame, embeddings: DataFrame, now, similarity: float = SIMILARITY, edges: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Pairs of close live memories that decide all merges; retired memories take no part."""
    return class_pairs(*guard_classes(memories, embeddings, now, edges, facts, similarity))


def every_pair(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of close memories, each as the pairs of its two classes: as many rows as there are pairs of copies."""
    side = lambda x: classes.select("entity_id", F.col("id").alias(x), F.col("class").alias(f"_{x}"))
    rest = [c for c in pairs.columns if c not in ("entity_id", "a", "b")]
    between = pairs.join(side("a"), ["entity_id", "a"]).join(side("b"), ["entity_id", "b"])
    between = between.groupBy("entity_id", F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).agg(*[F.first(c).alias(c) for c in rest])
    out = between.join(side("a"), ["entity_id", "_a"]).join(side("b"), ["entity_id", "_b"]).filter("a <> b")
    return out.select("entity_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest).distinct()


def judge_pairs(pairs: DataFrame, memories: DataFrame, edges: DataFrame, facts: DataFrame, now) -> DataFrame:
    """Add action and reason; the first guard that applies decides."""
    ids = pairs.select("entity_id", F.col("a").alias("id")).unionByName(pairs.select("entity_id", F.col("b").alias("id"))).distinct()
    rows = memories.join(ids, ["entity_id", "id"], "left_semi").select("entity_id", "id", "content", "memory_type", "is_latest", "created_at", X.trust(now).alias("trust"))
    rows = relate.text_features(protection(rows, facts)).drop("content")
    side = lambda p, name: rows.select("entity_id", F.col("id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in ("entity_id", "id")])
    both = pairs.join(side("n", "a"), ["entity_id", "a"]).join(side("o", "b"), ["entity_id", "b"])
    both = relate.contradicts(both, "_forward")
    flip = {f"n_{c}": F.col(f"o_{c}") for c in relate._SIDE} | {f"o_{c}": F.col(f"n_{c}") for c in relate._SIDE}
    kept = [c for c in both.columns if c not in flip]
    turned = relate.contradicts(both.select(*kept, *[v.alias(k) for k, v in flip.items()]), "_backward")
    linked = edges.filter("rel_type = 'UPDATES'").select("entity_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    turned = turned.join(linked.withColumn("_linked", F.lit(True)), ["entity_id", "a", "b"], "left")
    reason = (
        F.when(~(F.coalesce("n_is_latest", F.lit(True)) & F.coalesce("o_is_latest", F.lit(True))), "history_participation")
        .when(~F.col("n_memory_type").eqNullSafe(F.col("o_memory_type")), "memory_type")
        .when(F.col("n_protected") | F.col("o_protected"), "protected")
        .when(F.col("_forward") | F.col("_backward"), "contradiction")
        .when(F.col("_linked"), "updates_edge")
    )
    action = (
        F.when(F.col("reason") == "history_participation", "keep").when(F.col("reason") == "memory_type", "exempt_type")
        .when(F.col("reason") == "protected", "exempt_profile").when(F.col("reason") == "contradiction", "exempt_contradiction")
        .when(F.col("reason") == "updates_edge", "exempt_updates").otherwise("consolidated")
    )
    return turned.withColumn("reason", reason).withColumn("action", action).select(
        "entity_id", "a", "b", "similarity", "action", "reason",
        F.col("n_trust").alias("a_trust"), F.col("o_trust").alias("b_trust"), F.col("n_created_at").alias("a_created"), F.col("o_created_at").alias("b_created"),
    )


def representatives(judged: DataFrame) -> DataFrame:
    """(entity_id, id, label, representative) for members of duplicate groups.

    Groups are the connected components of consolidated pairs; the most
    trusted, then newest, then smallest member stands for the group.
    """
    good = judged.filter("action = 'consolidated'")
    groups = components(good.select("entity_id", "a", "b"))
    facts = good.select("entity_id", F.col("a").alias("id"), F.col("a_trust").alias("trust"), F.col("a_created").alias("created_at")).unionByName(
        good.select("entity_id", F.col("b").alias("id"), F.col("b_trust").alias("trust"), F.col("b_created").alias("created_at"))).distinct()
    members = groups.join(facts, ["entity_id", "id"])
    head = top_per(members, ["entity_id", "label"], [F.desc("trust"), F.desc("created_at"), F.asc("id")], 1)
    return members.join(head.select("entity_id", "label", F.col("id").alias("representative")), ["entity_id", "label"]).select("entity_id", "id", "label", "representative")


def merges(judged: DataFrame, grouped: DataFrame) -> DataFrame:
    """(entity_id, id, representative, label) of members that merge.

    A member merges only if its own pair with the representative consolidates;
    a veto is never bypassed through a third member.
    """
    asked = grouped.filter("id <> representative").withColumns({"a": F.least("id", "representative"), "b": F.greatest("id", "representative")})
    good = judged.filter("action = 'consolidated'").select("entity_id", "a", "b")
    return asked.join(good, ["entity_id", "a", "b"], "left_semi").select("entity_id", "id", "representative", "label")


def rewrite_relations(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Move EXTENDS and DERIVES_FROM of merged memories to their representatives.

    The batch form of landing merges one by one, by group and then id: an edge
    between a member and its own representative stays; between two members of
    one group only the smaller end, landed first, moves; all else moves.
    """
    side = lambda p: merged.select("entity_id", F.col("id").alias(f"{p}_id"), F.col("representative").alias(f"_{p}_rep"), F.col("label").alias(f"_{p}_group"))
    rows = edges.join(side("from"), ["entity_id", "from_id"], "left").join(side("to"), ["entity_id", "to_id"], "left")
    movable = F.col("rel_type").isin("EXTENDS", "DERIVES_FROM")
    own = F.coalesce(F.col("_from_rep") == F.col("to_id"), F.lit(False)) | F.coalesce(F.col("_to_rep") == F.col("from_id"), F.lit(False))
    siblings = F.coalesce(F.col("_from_group") == F.col("_to_group"), F.lit(False))
    move_from = movable & ~own & F.col("_from_rep").isNotNull() & (~siblings | (F.col("from_id") < F.col("to_id")))
    move_to = movable & ~own & F.col("_to_rep").isNotNull() & (~siblings | (F.col("to_id") < F.col("from_id")))
    out = rows.withColumns({"_f": F.when(move_from, F.col("_from_rep")).otherwise(F.col("from_id")), "_t": F.when(move_to, F.col("_to_rep")).otherwise(F.col("to_id"))})
    return out.withColumns({"from_id": F.col("_f"), "to_id": F.col("_t")}).select(*edges.columns)


def rewrite_mentions(mention_edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Move MENTIONS of merged memories; equal node and spelling become one edge."""
    side = merged.select("entity_id", F.col("id").alias("memory_id"), F.col("representative").alias("_rep"))
    rows = mention_edges.join(side, ["entity_id", "memory_id"], "left")
    rows = rows.withColumns({"_moved": F.col("_rep").isNotNull(), "_from": F.col("memory_id"), "memory_id": F.coalesce("_rep", "memory_id")})
    keys = ["entity_id", "memory_id", "mention_id", "surface_form"]
    rest = [c for c in mention_edges.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("_moved", "_from")).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*mention_edges.columns)


def retire_merged(memories: DataFrame, merged: DataFrame, now) -> DataFrame:
    """Merged memories become history that points to their representative."""
    side = merged.select("entity_id", "id", F.col("representative").alias("_rep"))
    rows = memories.join(side, ["entity_id", "id"], "left")
    hit = F.col("_rep").isNotNull()
    note = F.create_map(F.lit("reason"), F.lit("consolidated"))
    clean = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "reason")
    return rows.withColumns({
        "is_latest": F.when(hit, F.lit(False)).otherwise(F.col("is_latest")), "replaced_by": F.when(hit, F.col("_rep")).otherwise(F.col("replaced_by")),
        "expired_at": F.when(hit, X.at(now)).otherwise(F.col("expired_at")), "updated_at": F.when(hit, X.at(now)).otherwise(F.col("updated_at")),
        "metadata": F.when(hit, F.map_concat(clean, note)).otherwise(F.col("metadata")),
    }).select(*memories.columns)
