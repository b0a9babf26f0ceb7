"""Reads over memory tables: latest, maintenance, recent, lookups, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X


def newest() -> list[Column]:
    """Newest first; the id breaks ties."""
    return [F.desc("created_at"), F.asc("id")]


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """First ``limit`` rows of each key; all rows without a limit.

    Spark turns the rank filter into a group limit that runs before the
    shuffle, so a hot key sends at most ``limit`` rows per map task.
    """
    if limit is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def latest_memories(memories: DataFrame, now, limit: int | None = None, memory_type: str | None = None) -> DataFrame:
    """Live and valid memories of every entity, the newest ``limit`` if one is given."""
    live = memories.filter(F.col("is_latest") & X.is_valid(now, inclusive=False))
    if memory_type is not None:
        live = live.filter(F.col("memory_type") == memory_type)
    return top_per(live, ["entity_id"], newest(), limit)


def maintenance_candidates(memories: DataFrame, limit: int | None = None) -> DataFrame:
    """Live memories of every entity, expired ones included; the newest ``limit`` if one is given."""
    return top_per(memories.filter("is_latest"), ["entity_id"], newest(), limit)


def recent_memories(memories: DataFrame, now, since_minutes: int = 120, limit: int | None = None) -> DataFrame:
    """Live memories of the last minutes, over all entities; the newest ``limit`` if one is given."""
    since = X.at(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(since_minutes), F.lit(0))
    recent = memories.filter(F.col("is_latest") & (F.col("created_at") >= since))
    return recent if limit is None else recent.orderBy(*newest()).limit(limit)


def entity_ids(memories: DataFrame) -> DataFrame:
    return memories.filter("is_latest").select("entity_id").distinct()


def lookup(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``table`` whose key is asked for; absent keys give no row."""
    return table.join(keys.select(*on).distinct(), on, "left_semi")


def existing(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Asked keys with a flag telling whether the table holds them."""
    held = table.select(*on).distinct().withColumn("_held", F.lit(True))
    return keys.select(*on).distinct().join(held, on, "left").select(*on, F.coalesce("_held", F.lit(False)).alias("exists"))


def keyset_page(table: DataFrame, page_size: int, after: tuple | None = None, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """One page on (time desc, id desc); ``has_more`` says if another follows.

    The position is a pair, so rows sharing a timestamp are never skipped.
    """
    if after is not None:
        moment, row_id = F.lit(str(after[0])).cast("timestamp"), F.lit(after[1])
        table = table.filter(
            (F.col(time_col) < moment) | ((F.col(time_col) == moment) & (F.col(id_col) < row_id))
        )
    probe = table.orderBy(F.desc(time_col), F.desc(id_col)).limit(page_size + 1)
    # At most page_size + 1 rows reach this window.
    order = Window.orderBy(F.desc(time_col), F.desc(id_col))
    ranked = probe.withColumn("position", F.row_number().over(order))
    ranked = ranked.withColumn("has_more", F.max("position").over(Window.partitionBy()) > page_size)
    return ranked.filter(F.col("position") <= page_size)


def public_view(memories: DataFrame) -> DataFrame:
    """The columns of a memory that callers see; the summary is cut to 200."""
    return memories.select(
        "id", "content", F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary"),
        F.coalesce("memory_type", F.lit("fact")).alias("memory_type"), "container_tag", "confidence", "is_latest", "created_at",
    )


def type_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("entity_id", "memory_type").agg(F.count(F.lit(1)).alias("memories"))


def timeline(memories: DataFrame, now) -> DataFrame:
    """Counts by Today, Yesterday, This Week, Last Week, Older; weeks start on Sunday."""
    today = F.to_date(X.at(now))
    day = F.to_date("created_at")
    week_start = F.date_sub(today, F.dayofweek(today) - 1)
    bucket = (
        F.when(day == today, "Today")
        .when(day == F.date_sub(today, 1), "Yesterday")
        .when(day >= week_start, "This Week")
        .when(day >= F.date_sub(week_start, 7), "Last Week")
        .otherwise("Older")
    )
    return memories.groupBy("entity_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("memories"))


def graph_nodes(memories: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Node table of the graph export."""
    label = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.substring("content", 1, 60))
    return latest_memories(memories, now, limit).select(
        "entity_id", "id", label.alias("label"), "memory_type", "confidence", "created_at"
    )


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge table of the graph export: edges between exported nodes."""
    ids = nodes.select("entity_id", F.col("id").alias("from_id"))
    return (
        edges.select("entity_id", "from_id", "to_id", "rel_type")
        .join(ids, ["entity_id", "from_id"], "left_semi")
        .join(ids.withColumnRenamed("from_id", "to_id"), ["entity_id", "to_id"], "left_semi")
    )


def orphans(memories: DataFrame, embeddings: DataFrame, now, lookback_minutes: int = 120, limit: int | None = None) -> DataFrame:
    """Recent live memories without a vector, marked repairable or blank.

    Rows that have a vector are left out before any limit, so a run with a
    limit works on the newest orphans and the next run on the following ones.
    """
    vectors = embeddings.select("entity_id", F.col("chunk_id").alias("id")).distinct()
    missing = recent_memories(memories, now, lookback_minutes).join(vectors, ["entity_id", "id"], "left_anti")
    if limit is not None:
        missing = missing.orderBy(*newest()).limit(limit)
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return missing.select("entity_id", "id", "created_at", F.when(blank, "failed").otherwise("repaired").alias("outcome"))


def repair_orphans(memories: DataFrame, embeddings: DataFrame, found: DataFrame, now, embed) -> tuple[DataFrame, DataFrame]:
    """Memories and vectors after a repair run.

    Repairable orphans get the vector that ``embed(content)`` makes; blank ones
    are retired with the reason ``no_content``.
    """
    marks = found.select("entity_id", "id", F.col("outcome").alias("_outcome"))
    joined = memories.join(marks, ["entity_id", "id"], "left")
    failed = F.coalesce(F.col("_outcome") == "failed", F.lit(False))
    after = joined.withColumns({
        "is_latest": F.col("is_latest") & ~failed, "replaced_by": F.when(failed, "no_content").otherwise(F.col("replaced_by")),
        "expired_at": F.when(failed, X.at(now)).otherwise(F.col("expired_at")), "updated_at": F.when(failed, X.at(now)).otherwise(F.col("updated_at")),
    }).select(*memories.columns)
    new = joined.filter("_outcome = 'repaired'").select("entity_id", F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("document_id"), F.col("content").alias("text"), embed(F.col("content")).alias("embedding"))
    return after, embeddings.unionByName(new, allowMissingColumns=True)


def spaces_with_counts(spaces: DataFrame, memories: DataFrame) -> DataFrame:
    """Spaces of an entity with the number of memories they show."""
    counts = memories.filter(F.col("container_tag").isNotNull()).groupBy("entity_id", F.col("container_tag").alias("tag")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return spaces.join(counts, ["entity_id", "tag"], "left").select(
        "entity_id", "tag", "name", F.coalesce("n", F.lit(0)).alias("memory_count"), (F.col("tag") != "default").alias("after_default")
    )
