"""Profiles of all entities, their configuration, incremental merge, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.scans import latest_memories, newest, top_per

# Profile settings where an entity has none of its own.
DEFAULTS = {"static_max_items": 10, "dynamic_max_items": 5, "min_confidence_static": 0.5, "min_confidence_dynamic": 0.3, "dynamic_lookback_days": 7}
# Fixed value: source label of dynamic facts.
DYNAMIC_SOURCE = "最近对话"


def with_config(df: DataFrame, config: DataFrame | None) -> DataFrame:
    """Add the profile settings of each row's entity, defaults filled in."""
    if config is None:
        return df.withColumns({name: F.lit(value) for name, value in DEFAULTS.items()})
    given = [c for c in DEFAULTS if c in config.columns]
    side = config.select("entity_id", *[F.col(c).alias(f"_cfg_{c}") for c in given])
    out = df.join(side, "entity_id", "left")
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(f"_cfg_{name}"), F.lit(value)) if name in given else F.lit(value))
    return out.drop(*[f"_cfg_{c}" for c in given])


def _fact_kind(now):
    cutoff = X.at(now) - F.make_dt_interval(F.col("dynamic_lookback_days"))
    kind = F.coalesce("memory_type", F.lit("fact"))
    return (
        F.when(kind.isin("fact", "preference") & (F.col("trust") >= F.col("min_confidence_static")), "static")
        .when((kind == "episodic") & (F.col("trust") >= F.col("min_confidence_dynamic")) & (F.col("created_at") >= cutoff), "dynamic")
    )


def _longest(config: DataFrame | None) -> int:
    """Largest list length that any entity is set to; one number from the settings."""
    names = [n for n in ("static_max_items", "dynamic_max_items") if config is not None and n in config.columns]
    found = config.agg(*[F.max(n).alias(n) for n in names]).first() if names else ()
    return max(DEFAULTS["static_max_items"], DEFAULTS["dynamic_max_items"], *[x for x in found if x is not None])


def _ranked(facts: DataFrame, config: DataFrame | None) -> DataFrame:
    """Best facts of each list first; lists end at the entity's own length.

    The literal bound lets Spark cut each list before the shuffle, so a hot
    entity sends a few rows per task; the entity's own bound follows.
    """
    order = Window.partitionBy("entity_id", "kind").orderBy(F.desc("importance"), F.desc("created_at"), F.asc("memory_id"))
    room = F.when(F.col("kind") == "static", F.col("static_max_items")).otherwise(F.col("dynamic_max_items"))
    return facts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _longest(config)).filter(F.col("rank") <= room)


_COLUMNS = ["entity_id", "kind", "rank", "memory_id", "content", "importance", "source", "created_at"]


def profile_facts(memories: DataFrame, edges: DataFrame | None, now, config: DataFrame | None = None) -> DataFrame:
    """Static and dynamic facts of every entity, from all its live and valid memories."""
    pool = latest_memories(memories, now)
    if edges is None:
        pool = pool.withColumn("_links", F.lit(0))
    else:
        links = edges.groupBy("entity_id", F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("_links"))
        pool = pool.join(links, ["entity_id", "id"], "left")
    scored = with_config(pool, config).withColumn("trust", X.trust(now))
    scored = scored.withColumn("importance", X.importance(now, F.col("trust"), F.col("_links"))).withColumn("kind", _fact_kind(now))
    facts = scored.filter(F.col("kind").isNotNull()).withColumn("memory_id", F.col("id"))
    facts = facts.withColumn("source", F.when(F.col("kind") == "dynamic", DYNAMIC_SOURCE))
    return _ranked(facts, config).select(*_COLUMNS)


def profile_summary(memories: DataFrame, facts: DataFrame, now) -> DataFrame:
    """Per entity: memories read, static and dynamic facts."""
    read = latest_memories(memories, now).groupBy("entity_id").agg(F.count(F.lit(1)).alias("memory_count"))
    counts = facts.groupBy("entity_id").agg(
        F.count(F.when(F.col("kind") == "static", 1)).alias("static_facts"), F.count(F.when(F.col("kind") == "dynamic", 1)).alias("dynamic_facts")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return read.join(counts, "entity_id", "left").select("entity_id", "memory_count", zero("static_facts"), zero("dynamic_facts"))


def merge_incremental(facts: DataFrame, memories: DataFrame, edges: DataFrame, new_ids: DataFrame, now, config: DataFrame | None = None) -> DataFrame:
    """Existing facts without those a new memory updates, plus new facts by trust."""
    fresh = new_ids.select("entity_id", F.col("id").alias("from_id")).distinct()
    replaced = edges.filter("rel_type = 'UPDATES'").join(fresh, ["entity_id", "from_id"], "left_semi").select("entity_id", F.col("to_id").alias("memory_id")).distinct()
    kept = facts.join(replaced, ["entity_id", "memory_id"], "left_anti").select("entity_id", "kind", "memory_id", "content", "importance", "source", "created_at")
    added = memories.join(new_ids.select("entity_id", "id").distinct(), ["entity_id", "id"], "left_semi")
    added = with_config(added, config).withColumn("trust", X.trust(now)).withColumn("kind", _fact_kind(now)).filter(F.col("kind").isNotNull())
    added = added.select(
        "entity_id", "kind", F.col("id").alias("memory_id"), "content", F.col("trust").alias("importance"),
        F.when(F.col("kind") == "dynamic", DYNAMIC_SOURCE).alias("source"), "created_at",
    )
    both = with_config(kept.unionByName(added), config)
    cutoff = X.at(now) - F.make_dt_interval(F.col("dynamic_lookback_days"))
    both = both.filter((F.col("kind") == "static") | (F.col("created_at") >= cutoff))
    return _ranked(both, config).select(*_COLUMNS)


def digest(facts: DataFrame, memories: DataFrame, now, max_recent: int = 10) -> DataFrame:
    """One Markdown text per entity from its profile and recent memories."""
    cutoff = X.at(now) - F.expr("INTERVAL '7' DAY")
    recent = latest_memories(memories, now).filter((F.col("created_at") > cutoff) & (F.col("memory_type") != "fact"))
    recent = recent.withColumn("_untyped", F.col("internal_type").isNull())
    recent = top_per(recent, ["entity_id"], [F.asc("_untyped"), *newest()], max_recent)
    order = Window.partitionBy("entity_id").orderBy(F.asc("_untyped"), *newest())
    recent = recent.select(
        "entity_id", F.row_number().over(order).alias("rank"), F.lit("recent").alias("kind"),
        F.concat(F.lit("- "), F.col("content"), F.lit(" _("), F.coalesce("internal_type", "memory_type"), F.lit(")_")).alias("line"),
    )
    source = F.when(F.col("source").isNotNull(), F.concat(F.lit(" (source: "), F.col("source"), F.lit(")"))).otherwise("")
    lines = facts.select("entity_id", "rank", "kind", F.concat(F.lit("- "), F.col("content"), source).alias("line")).unionByName(recent.select("entity_id", "rank", "kind", "line"))

    def block(kind: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "line"))))
        return F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias(kind)

    parts = lines.groupBy("entity_id").agg(block("static"), block("dynamic"), block("recent"))
    counts = latest_memories(memories, now).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.join(parts, "entity_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    section = lambda title, c: F.when(text(c) != "", F.concat(F.lit(f"## {title}\n\n"), text(c), F.lit("\n\n"))).otherwise("")
    static = F.when(text("static") == "", F.lit("## Static Facts\n\n_No static facts yet._\n\n")).otherwise(section("Static Facts", "static"))
    moment = F.date_format(X.at(now), "yyyy-MM-dd'T'HH:mm:ss")
    return whole.select("entity_id", F.concat(
        F.lit("# Memory Summary: "), "entity_id", F.lit("\n\n_Generated at "), moment, F.lit("_\n\n"), static,
        section("Recent Context", "dynamic"), section("Recent Memories", "recent"), F.lit("---\n_Total memories: "), F.col("n").cast("string"), F.lit("_"),
    ).alias("digest"))


def space_tag(name):
    return F.regexp_replace(F.lower(name), " ", "-")


def create_spaces(spaces: DataFrame, asked: DataFrame) -> DataFrame:
    """Spaces after creating the asked ones; a tag that exists stays as it is."""
    new = asked.withColumn("tag", space_tag(F.col("name"))).groupBy("entity_id", "tag").agg(F.min("name").alias("name"))
    return spaces.unionByName(new.join(spaces, ["entity_id", "tag"], "left_anti"), allowMissingColumns=True)


def rename_spaces(spaces: DataFrame, names: DataFrame) -> DataFrame:
    """New display names; tags never change."""
    return spaces.join(names.select("entity_id", "tag", F.col("name").alias("_n")), ["entity_id", "tag"], "left").withColumn("name", F.coalesce("_n", "name")).drop("_n")


def delete_spaces(spaces: DataFrame, memories: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove spaces and detach their memories, which stay."""
    keys = gone.select("entity_id", "tag").distinct()
    left = spaces.join(keys, ["entity_id", "tag"], "left_anti")
    hit = keys.select("entity_id", F.col("tag").alias("container_tag"), F.lit(True).alias("_gone"))
    detached = memories.join(hit, ["entity_id", "container_tag"], "left").withColumn(
        "container_tag", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("container_tag"))
    ).drop("_gone")
    return left, detached.select(*memories.columns)
