"""Mention extraction, resolution, counting and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.scans import newest, top_per
from factloom.session import cut

RULE_CONFIDENCE = 0.9
MIN_CONFIDENCE = 0.5


def _index_terms(text: Column) -> Column:
    """Latin words and numbers, and every other character by itself."""
    lowered = F.lower(text)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"([a-z0-9]+|[^a-z0-9\s\p{Punct}])"), 1))


def _index_term(key: Column) -> Column:
    """The term of a key its texts must hold: its longest word, else its first character.

    A match is bounded on both sides, so each word of the key is a whole word
    of the text.
    """
    words = F.regexp_extract_all(F.lower(key), F.lit("([a-z0-9]+)"), 1)
    longest = F.element_at(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"]
    return F.when(F.size(words) > 0, longest).otherwise(F.substring(F.lower(key), 1, 1))


def extract_mentions(texts: DataFrame, gazetteer: DataFrame, confidence: float = RULE_CONFIDENCE) -> DataFrame:
    """First hit of every gazetteer key in every text, in order of occurrence.

    ``texts`` has (entity_id, memory_id, content, created_at), ``gazetteer``
    (ord, key, canonical, type). Keys meet texts by an equi-join on index
    terms, so cost follows the hits and not texts times keys; only texts with
    a hit are read again for the exact, bounded, case-insensitive match.
    """
    # Written down, a small gazetteer has a known size and meets the terms where they are read.
    keys = cut(gazetteer.withColumn("term", _index_term(F.col("key"))))
    terms = texts.select("entity_id", "memory_id", F.explode(_index_terms(F.col("content"))).alias("term"))
    hits = (
        terms.join(keys, "term")
        .groupBy("entity_id", "memory_id")
        .agg(F.collect_set(F.struct("ord", "key", "canonical", "type")).alias("keys"))
    )
    rows = texts.join(hits, ["entity_id", "memory_id"]).select("*", F.explode("keys").alias("k"))
    pattern = F.concat(F.lit(r"(?iu)(?<![a-z0-9])\Q"), F.col("k.key"), F.lit(r"\E(?![a-z0-9])"))
    rows = rows.withColumn("position", F.regexp_instr("content", pattern)).filter("position > 0")
    return rows.select(
        "entity_id", "memory_id", "created_at", "position", F.col("k.ord").alias("ord"),
        F.call_function("regexp_extract", F.col("content"), pattern, F.lit(0)).alias("surface_form"), F.col("k.canonical").alias("canonical_form"),
        F.col("k.type").alias("type"), F.lit(confidence).alias("confidence"),
    )


def attach_mentions(found: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """MENTIONS edges: normalised type, gate on confidence, one edge per surface.

    The node id follows from entity, canonical form and type.
    """
    canonical = F.coalesce(F.nullif(F.col("canonical_form"), F.lit("")), F.col("surface_form"))
    rows = found.select(
        "entity_id", "memory_id", canonical.alias("canonical_form"), X.mention_type(F.col("type")).alias("type"), "surface_form",
        X.clamp_confidence(F.col("confidence")).alias("confidence"), "created_at",
    ).filter((F.col("confidence") >= min_confidence) & (F.col("surface_form") != ""))
    return rows.groupBy(
        "entity_id", "memory_id", F.sha2(F.concat_ws("\x1f", "entity_id", "canonical_form", "type"), 256).alias("mention_id"),
        "canonical_form", "type", "surface_form",
    ).agg(F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"))


def mention_nodes(edges: DataFrame) -> DataFrame:
    """One node per mention: aliases in first-seen order, count, first and last seen.

    Surfaces are counted first, so a mention of a billion memories sends only
    its distinct spellings to one group.
    """
    spelled = edges.groupBy("entity_id", "mention_id", "canonical_form", "type", "surface_form").agg(
        F.count(F.lit(1)).alias("_n"), F.min("created_at").alias("_first"), F.max("created_at").alias("_last")
    )
    return spelled.groupBy("entity_id", "mention_id", "canonical_form", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "surface_form"))), lambda s: s["surface_form"]).alias("aliases"),
        F.sum("_n").alias("mention_count"), F.min("_first").alias("created_at"), F.max("_last").alias("last_seen_at"),
    )


def recount_mentions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts from the remaining edges; nodes without any edge go."""
    counts = edges.groupBy("entity_id", "mention_id").agg(F.count(F.lit(1)).alias("mention_count"))
    return nodes.drop("mention_count").join(counts, ["entity_id", "mention_id"])


def mentions_of_memories(edges: DataFrame, nodes: DataFrame, memory_ids: DataFrame) -> DataFrame:
    wanted = edges.join(memory_ids.select("entity_id", "memory_id").distinct(), ["entity_id", "memory_id"], "left_semi")
    return wanted.select("entity_id", "memory_id", "mention_id", "surface_form").join(
        nodes.select("entity_id", "mention_id", "canonical_form", "type"), ["entity_id", "mention_id"]
    )


def memories_mentioning(memories: DataFrame, edges: DataFrame, asks: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest memories per ask (query_id, entity_id, about): form or node id."""
    forms = edges.select("entity_id", "mention_id", "canonical_form").distinct()
    by_form = asks.join(forms, (asks["entity_id"] == forms["entity_id"]) & (asks["about"] == forms["canonical_form"])).select("query_id", asks["entity_id"], "mention_id")
    by_id = asks.join(forms, (asks["entity_id"] == forms["entity_id"]) & (asks["about"] == forms["mention_id"])).select("query_id", asks["entity_id"], "mention_id")
    ids = by_form.unionByName(by_id).distinct()
    hit = edges.select("entity_id", "mention_id", F.col("memory_id").alias("id")).join(ids, ["entity_id", "mention_id"])
    hit = hit.select("query_id", "entity_id", "id").distinct()
    rows = memories.filter("is_latest").join(hit, ["entity_id", "id"])
    return rows if limit is None else top_per(rows, ["query_id"], newest(), limit)
