"""Walks, lineage, components and checks over memory edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.scans import newest, top_per
from factloom.session import cut

RELATIONS = ["UPDATES", "EXTENDS", "DERIVES_FROM"]
MAX_DEPTH = 4


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from each of its ends: (entity_id, id, rel_type, other, created_at, outgoing)."""
    forward = edges.select("entity_id", F.col("from_id").alias("id"), "rel_type", F.col("to_id").alias("other"), "created_at", F.lit(True).alias("outgoing"))
    backward = edges.select("entity_id", F.col("to_id").alias("id"), "rel_type", F.col("from_id").alias("other"), "created_at", F.lit(False).alias("outgoing"))
    return forward.unionByName(backward)


def neighbours(edges: DataFrame, memories: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """Both-way edges with the neighbour's own state; nothing crosses entities."""
    wanted = edges.filter(F.col("rel_type").isin(rel_types or RELATIONS))
    state = memories.select("entity_id", F.col("id").alias("other"), F.coalesce("is_latest", F.lit(True)).alias("other_latest"))
    return both_ways(wanted).join(state, ["entity_id", "other"])


def replaced_by_whom(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Incoming UPDATES of the asked memories."""
    asked = ids.select("entity_id", F.col("id").alias("to_id")).distinct()
    return edges.filter("rel_type = 'UPDATES'").join(asked, ["entity_id", "to_id"], "left_semi").select("entity_id", F.col("to_id").alias("id"), F.col("from_id").alias("replaced_by"))


def update_lineage(edges: DataFrame) -> DataFrame:
    """Newest version of every memory on an UPDATES chain and the steps to it.

    A memory follows its first superseder. Pointer doubling reaches the end of
    a chain of n versions in about log2(n) joins. On a cycle no version is the
    newest: its memories, and those that lead into it, have a null ``newest``
    and null steps. Steps only double while an end lies ahead, so the number of
    rounds is bounded by log2 of the number of edges.
    """
    up = edges.filter("rel_type = 'UPDATES'")
    parent = up.groupBy("entity_id", F.col("to_id").alias("id")).agg(F.min(F.struct("created_at", "from_id"))["from_id"].alias("newest"))
    tops = up.select("entity_id", F.col("from_id").alias("id")).distinct().join(parent, ["entity_id", "id"], "left_anti")
    state = parent.withColumn("steps", F.lit(1).cast("long")).unionByName(tops.select("entity_id", "id", F.col("id").alias("newest"), F.lit(0).cast("long").alias("steps")))
    state = cut(state)
    for _ in range(state.count().bit_length() + 1):
        target = state.select("entity_id", F.col("id").alias("newest"), F.col("newest").alias("_next"), F.col("steps").alias("_more"))
        moved = state.join(target, ["entity_id", "newest"]).select("entity_id", "id", F.col("_next").alias("newest"), (F.col("steps") + F.col("_more")).alias("steps"), (F.col("_more") > 0).alias("_moved"))
        moved = cut(moved)
        state = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return state
    # Whoever still moves after more rounds than any chain needs is on a cycle.
    return moved.select("entity_id", "id", F.when(~F.col("_moved"), F.col("newest")).alias("newest"), F.when(~F.col("_moved"), F.col("steps")).alias("steps"))


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of undirected (entity_id, a, b): smallest id labels.

    Each round sends labels along edges and then follows label pointers, so
    long chains settle in logarithmically many rounds. Messages are reduced by
    ``min`` before the shuffle; hubs cost no more than their edges.
    """
    links = pairs.select("entity_id", "a", "b").unionByName(pairs.select("entity_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = cut(links)
    labels = cut(links.groupBy("entity_id", F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        said = links.join(labels.select("entity_id", F.col("id").alias("b"), F.col("label").alias("_l")), ["entity_id", "b"])
        heard = said.groupBy("entity_id", F.col("a").alias("id")).agg(F.min("_l").alias("_heard"))
        stepped = labels.join(heard, ["entity_id", "id"]).select("entity_id", "id", "label", F.least("label", "_heard").alias("_new"))
        jump = stepped.select("entity_id", F.col("id").alias("_new"), F.col("_new").alias("_far"))
        joined = stepped.join(jump, ["entity_id", "_new"], "left").select("entity_id", "id", "label", F.least("_new", F.coalesce("_far", "_new")).alias("_next"))
        joined = cut(joined)
        changed = not joined.filter("_next <> label").isEmpty()
        labels = joined.select("entity_id", "id", F.col("_next").alias("label"))
        if not changed:
            return labels


def _order_key(moment, *parts):
    return [F.lpad(F.unix_micros(moment).cast("string"), 20, "0"), *parts]


def walk(seeds: DataFrame, memories: DataFrame, edges: DataFrame, mention_edges: DataFrame, depth: int, max_siblings: int | None = None) -> DataFrame:
    """Memories reached from the seeds of each query within ``depth`` hops.

    ``seeds`` has (query_id, entity_id, id, position). A hop is a shared
    mention or a relation edge in either direction. Each memory appears once,
    at its shallowest depth with the path of its first reach: seeds by
    position, mentions before edges, older links first, newer siblings first.
    Retired memories are reached along UPDATES only and end the walk.

    Mentions stay bipartite: per query a mention is opened once, by its first
    reach, and hands out its siblings (the newest ``max_siblings`` if given);
    pairs of siblings never exist.
    """
    depth = max(0, min(depth, MAX_DEPTH))
    step = lambda kind, ident: F.array(F.struct(kind.alias("kind"), ident.alias("id")))
    latest = memories.filter(F.coalesce("is_latest", F.lit(True))).select("entity_id", "id", "created_at")
    links = mention_edges.groupBy("entity_id", F.col("memory_id").alias("id"), "mention_id").agg(F.min("created_at").alias("_at"))
    members = links.select("entity_id", "id", "mention_id").join(latest, ["entity_id", "id"])
    siblings = top_per(members, ["entity_id", "mention_id"], newest(), max_siblings).select("entity_id", "mention_id", F.col("id").alias("other"), "created_at")
    near = neighbours(edges, memories).filter(F.col("other_latest") | (F.col("rel_type") == "UPDATES"))
    if depth > 1:
        # Every level looks into the same three tables; rank siblings once.
        siblings, near = cut(siblings), cut(near)
    far_first = F.lpad((F.lit(9_000_000_000_000_000) - F.unix_micros("created_at")).cast("string"), 20, "0")

    frontier = seeds.select(
        "query_id", "entity_id", "id", F.array(F.lpad(F.col("position").cast("string"), 12, "0")).alias("key"),
        step(F.lit("memory"), F.col("id")).alias("path"),
    )
    frontier = cut(frontier)
    visited = frontier.select("query_id", "id")
    opened = None
    found = None
    for level in range(1, depth + 1):
        doors = frontier.join(links, ["entity_id", "id"]).select(
            "query_id", "entity_id", "mention_id", F.concat("key", F.array(F.lit("0"), *_order_key(F.col("_at"), F.col("mention_id")))).alias("key"),
            F.concat("path", step(F.lit("mention"), F.col("mention_id"))).alias("path"),
        )
        if opened is not None:
            doors = doors.join(opened, ["query_id", "mention_id"], "left_anti")
        doors = cut(doors.groupBy("query_id", "entity_id", "mention_id").agg(F.min(F.struct("key", "path")).alias("_f")).select("query_id", "entity_id", "mention_id", "_f.key", "_f.path"))
        opened = doors.select("query_id", "mention_id") if opened is None else opened.unionByName(doors.select("query_id", "mention_id"))
        bridged = doors.join(siblings, ["entity_id", "mention_id"]).select(
            "query_id", "entity_id", "other", F.concat("key", F.array(far_first, F.col("other"))).alias("key"),
            F.concat("path", step(F.lit("memory"), F.col("other"))).alias("path"), F.lit(False).alias("historical"),
        )
        related = frontier.join(near, ["entity_id", "id"]).select(
            "query_id", "entity_id", "other", F.concat("key", F.array(F.lit("1"), *_order_key(F.col("created_at"), F.col("rel_type"), F.col("other")))).alias("key"),
            F.concat("path", step(F.col("rel_type"), F.col("other"))).alias("path"), (~F.col("other_latest")).alias("historical"),
        )
        reach = bridged.unionByName(related).withColumnRenamed("other", "id").join(visited, ["query_id", "id"], "left_anti")
        hops = reach.groupBy("query_id", "entity_id", "id").agg(F.min(F.struct("key", "path", "historical")).alias("_f"))
        hops = cut(hops.select("query_id", "entity_id", "id", "_f.key", "_f.path", "_f.historical", F.lit(level).alias("depth")))
        found = hops if found is None else found.unionByName(hops)
        visited = visited.unionByName(hops.select("query_id", "id"))
        frontier = hops.filter("NOT historical").select("query_id", "entity_id", "id", "key", "path")
        if level < depth and frontier.isEmpty():
            break
    if found is None:
        return frontier.select("query_id", "entity_id", "id", "key", "path", F.lit(False).alias("historical"), F.lit(0).alias("depth")).filter(F.lit(False))
    return found


def path_text(path: str = "path"):
    """A path as one string, kind:id joined by ' > '."""
    return F.array_join(F.transform(path, lambda s: F.concat_ws(":", s["kind"], s["id"])), " > ")


def relations_with(edges: DataFrame, rel_type: str, key: str, values: DataFrame) -> DataFrame:
    """Edges of a type whose property has one of the asked values."""
    asked = values.select(F.col("value").alias("_v")).distinct()
    return edges.filter(F.col("rel_type") == rel_type).withColumn("_v", F.col("props")[key]).join(asked, "_v", "left_semi").drop("_v")


def set_relation_property(edges: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set one property on the edges named in ``changes`` (…, value)."""
    on = ["entity_id", "from_id", "to_id", "rel_type"]
    out = edges.join(changes.select(*on, F.col("value").alias("_v")), on, "left")
    kept = F.map_filter("props", lambda k, v: k != key)
    return out.withColumn("props", F.when(F.col("_v").isNotNull(), F.map_concat(kept, F.create_map(F.lit(key), F.col("_v")))).otherwise(F.col("props"))).drop("_v")


def invariant_report(memories: DataFrame, edges: DataFrame, mention_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per kind of violation with its count; all zero on sound tables."""
    state = memories.select("entity_id", "id", "is_latest", "replaced_by")
    updates = edges.filter("rel_type = 'UPDATES'")
    targets = updates.join(state.withColumnRenamed("id", "to_id"), ["entity_id", "to_id"])
    live_target = targets.filter("is_latest")
    wrong_pointer = targets.filter("NOT is_latest AND replaced_by IS NOT NULL AND replaced_by <> from_id")
    self_loops = edges.filter("from_id = to_id")
    owners = memories.select(F.col("id"), F.col("entity_id").alias("_owner"))
    foreign = edges.join(owners.withColumnRenamed("id", "to_id"), "to_id").filter("_owner <> entity_id")
    counted = mention_edges.groupBy("entity_id", "mention_id").agg(F.count(F.lit(1)).alias("_n"))
    miscount = nodes.join(counted, ["entity_id", "mention_id"], "left").filter(F.coalesce("_n", F.lit(0)) != F.col("mention_count"))
    parts = [("update_target_live", live_target), ("replaced_by_differs", wrong_pointer), ("self_loop", self_loops), ("crosses_entity", foreign), ("mention_count_wrong", miscount)]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "violations")
