"""Distributed sequence numbers and "newest k still alive" lookups.

Both are what a window over one entity would give, but an entity that holds a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scans import top_per
from factloom.session import cut


def running_count(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str) -> DataFrame:
    """Inclusive running count of ``flag`` per key in the given order.

    Rows are range-partitioned on key and order, counted inside each range,
    and every range adds the totals of the ranges of its key before it. Only
    one row per (key, range) meets in the second step.
    """
    local = (
        df.withColumn("_one", flag.cast("long"))
        .repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn("_range", F.spark_partition_id())
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The range number exists only in this one run, so it is written down.
    local = cut(local.withColumn("_local", F.sum("_one").over(within)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        local.groupBy(*keys, "_range").agg(F.sum("_one").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    )
    return local.join(offsets, [*keys, "_range"]).withColumn(out, F.col("_local") + F.col("_offset")).drop("_one", "_range", "_local", "_offset")


def arrival_sequence(memories: DataFrame) -> DataFrame:
    """(entity_id, id, seq, until): position by arrival and last position at
    which the memory is still valid (null where it never expires)."""
    rows = memories.select("entity_id", F.col("created_at").alias("_t"), F.lit(1).alias("_row"), "id")
    expiries = memories.filter(F.col("valid_until").isNotNull()).select("entity_id", F.col("valid_until").alias("_t"), F.lit(0).alias("_row"), "id")
    counted = running_count(rows.unionByName(expiries), ["entity_id"], ["_t", "_row", "id"], F.col("_row"), "seq")
    return counted.groupBy("entity_id", "id").agg(
        F.max(F.when(F.col("_row") == 1, F.col("seq"))).alias("seq"), F.max(F.when(F.col("_row") == 0, F.col("seq"))).alias("until")
    )


def _top_level(position: Column) -> Column:
    return F.length(F.bin(position)) - 1


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _cover(first: Column, last: Column) -> Column:
    """Dyadic blocks (level, node) that exactly tile positions first..last."""
    def at_level(level: Column) -> Column:
        size = _size(level)
        lo = F.floor((first + size - 1) / size)
        hi = F.floor((last + 1) / size) - 1
        block = lambda node: F.struct(level.alias("level"), node.cast("long").alias("node"))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        left = F.when((lo <= hi) & (lo % 2 == 1), F.array(block(lo))).otherwise(none)
        right = F.when((lo <= hi) & (hi % 2 == 0), F.array(block(hi))).otherwise(none)
        return F.concat(left, right)

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), _top_level(last)), at_level)))


def newest_alive(alive: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """For each probe position, the k newest earlier members alive there.

    ``alive`` has (entity_id, seq, end): a member counts for positions
    seq+1..end, ``end`` null meaning for ever. ``probes`` has (entity_id, seq).
    Lifetimes are tiled by dyadic blocks; a block keeps its k newest members,
    since all of its members cover every position in it. A position looks up
    its one block per level, so no entity is ever gathered in one place.
    """
    top = probes.groupBy("entity_id").agg(F.max("seq").alias("_top"))
    spans = (
        alive.join(top, "entity_id")
        .withColumn("_last", F.least(F.coalesce("end", F.col("_top")), F.col("_top")))
        .filter(F.col("_last") > F.col("seq"))
        .select("entity_id", F.col("seq").alias("o_seq"), F.explode(_cover(F.col("seq") + 1, F.col("_last"))).alias("_b"))
        .select("entity_id", "o_seq", "_b.level", "_b.node")
    )
    blocks = top_per(spans, ["entity_id", "level", "node"], [F.desc("o_seq")], k)
    levels = F.explode(F.sequence(F.lit(0), _top_level(F.col("seq")))).alias("level")
    asks = probes.select("entity_id", F.col("seq").alias("n_seq"), levels).withColumn(
        "node", F.floor(F.col("n_seq") / _size(F.col("level"))).cast("long")
    )
    found = asks.join(blocks, ["entity_id", "level", "node"]).select("entity_id", "n_seq", "o_seq")
    return top_per(found, ["entity_id", "n_seq"], [F.desc("o_seq")], k)
