"""Communities of linked memories: detection, activity, verdicts.

Memories that share a mention are neighbours. Mentions stay bipartite, so a
common one costs its memberships and not the pairs among its members. To count
a neighbour once that shares several, distinct sets of mentions are compared:
sets that share a light mention one by one, sets that share a hub by the hubs
they hold, of which there are few combinations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.graph import RELATIONS
from factloom.operators.ordering import running_count
from factloom.operators.scans import maintenance_candidates
from factloom.session import cut

SWEEPS = 50
#: Distinct mention sets above which a mention is a hub.
HUB = 200
ACTIVITY_THRESHOLD = 0.5
IMPORTANCE_THRESHOLD = 0.7


def participants(memories: DataFrame, limit: int | None = None) -> DataFrame:
    """The live memories of each entity, expired ones included; the newest ``limit`` if one is given."""
    return maintenance_candidates(memories, limit)


@dataclass
class Links:
    """Nodes (entity_id, id[, label]), relation neighbours (a, b) in both directions, memberships (id, mention_id)."""

    nodes: DataFrame
    related: DataFrame
    members: DataFrame


def links(nodes: DataFrame, edges: DataFrame, mention_edges: DataFrame, label: str | None = None) -> Links:
    """Neighbourhood of the nodes; ``label`` names a column with given communities."""
    ids = nodes.select("entity_id", "id")
    own = nodes.select("entity_id", "id", *([F.col(label).alias("label")] if label else []))
    one_way = edges.filter(F.col("rel_type").isin(RELATIONS) & (F.col("from_id") != F.col("to_id"))).select("entity_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = one_way.unionByName(one_way.select("entity_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    related = both.join(ids.withColumnRenamed("id", "a"), ["entity_id", "a"], "left_semi").join(ids.withColumnRenamed("id", "b"), ["entity_id", "b"], "left_semi")
    members = mention_edges.select("entity_id", F.col("memory_id").alias("id"), "mention_id").distinct().join(ids, ["entity_id", "id"], "left_semi")
    return Links(own, related, members)


def _winner(votes: DataFrame, key: str) -> DataFrame:
    """Label with the most votes per key, the smallest at a tie."""
    counted = votes.groupBy("entity_id", key, "label").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("entity_id", key).agg(F.min(F.struct((-F.col("_n")).alias("n"), "label"))["label"].alias("label"))


def first_half(ident: Column) -> Column:
    """Nodes that move in the first half of a sweep; the others move in the second."""
    return F.substring(F.md5(ident), 1, 1) < "8"


def propagate(linked: Links, sweeps: int = SWEEPS) -> tuple[DataFrame, bool]:
    """(entity_id, id, label) after label propagation, and whether it settled.

    A node takes the label with most votes among its own, its relation
    neighbours' and its shared mentions', a mention speaking for most of its members;
    ties go to the smallest label. Two halves of the nodes, by hash of id, move
    in turn, so that pairs do not swap for ever. It ends when a sweep changes
    nothing, when a state comes back, or after ``sweeps``.

    The reference moves nodes one by one in a fixed order and counts every
    neighbour of a shared mention; that order has no parallel form, and results
    may differ on graphs other than clear clusters.
    """
    nodes, related, members = cut(linked.nodes.select("entity_id", "id")), cut(linked.related), cut(linked.members)
    # A mention with one member only repeats that member's own vote.
    shared = members.groupBy("entity_id", "mention_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = cut(members.join(shared, ["entity_id", "mention_id"], "left_semi"))

    def moved(labels: DataFrame, half: bool) -> DataFrame:
        own = labels.select("entity_id", "id", "label")
        spoken = _winner(members.join(own, ["entity_id", "id"]).select("entity_id", "mention_id", "label"), "mention_id")
        turn = first_half(F.col("id")) == half
        votes = (
            own.filter(turn)
            .unionByName(related.join(own.withColumnRenamed("id", "b"), ["entity_id", "b"]).select("entity_id", F.col("a").alias("id"), "label").filter(turn))
            .unionByName(members.filter(turn).join(spoken, ["entity_id", "mention_id"]).select("entity_id", "id", "label"))
        )
        heard = _winner(votes, "id").withColumnRenamed("label", "_new")
        return labels.join(heard, ["entity_id", "id"], "left").select("entity_id", "id", F.coalesce("_new", "label").alias("label"), "before")

    labels = nodes.withColumn("label", F.col("id"))
    seen: set[int] = set()
    settled = False
    for _ in range(sweeps):
        labels = cut(moved(moved(labels.withColumn("before", F.col("label")), True), False))
        state = labels.agg(F.count(F.when(F.col("label") != F.col("before"), 1)).alias("moved"), F.sum(F.xxhash64("entity_id", "id", "label").cast("decimal(38,0)")).alias("mark")).first()
        labels = labels.drop("before")
        if not state.moved or state.mark in seen:
            settled = not state.moved
            break
        seen.add(state.mark)
    return labels, settled


@dataclass
class Around:
    """Who shares a mention with a node, by label, without a row per pair of nodes.

    ``sets`` has (entity_id, id, set_id, mentions, hubs_id) of nodes, hubs_id null
    where a set holds no hub. ``by_hubs`` (entity_id, hubs_id, label, n) counts all nodes that
    share a hub with such a set, ``by_set`` (entity_id, set_id, label, n) those
    that share a light mention and no hub. A node is in one of the two at most.
    """

    sets: DataFrame
    by_hubs: DataFrame
    by_set: DataFrame

    def at(self, rows: DataFrame, set_id: str, hubs_id: str, label: str, out: str) -> DataFrame:
        """``rows`` with the count of one label around a set."""
        first = self.by_hubs.select("entity_id", F.col("hubs_id").alias(hubs_id), F.col("label").alias(label), F.col("n").alias("_nh"))
        second = self.by_set.select("entity_id", F.col("set_id").alias(set_id), F.col("label").alias(label), F.col("n").alias("_ns"))
        joined = rows.join(first, ["entity_id", hubs_id, label], "left").join(second, ["entity_id", set_id, label], "left")
        return joined.withColumn(out, F.coalesce("_nh", F.lit(0)) + F.coalesce("_ns", F.lit(0))).drop("_nh", "_ns")

    def totals(self) -> DataFrame:
        """(entity_id, set_id, _all, _labels) of the distinct sets."""
        hubs = self.by_hubs.groupBy("entity_id", "hubs_id").agg(F.sum("n").alias("_ha"), F.count(F.lit(1)).alias("_hl"))
        distinct = self.sets.select("entity_id", "set_id", "hubs_id").distinct()
        light = self.by_set.join(distinct, ["entity_id", "set_id"])
        there = self.by_hubs.select("entity_id", "hubs_id", "label", F.lit(1).alias("_there"))
        light = light.join(there, ["entity_id", "hubs_id", "label"], "left").groupBy("entity_id", "set_id").agg(F.sum("n").alias("_sa"), F.count(F.when(F.col("_there").isNull(), 1)).alias("_sl"))
        both = distinct.join(hubs, ["entity_id", "hubs_id"], "left").join(light, ["entity_id", "set_id"], "left")
        plus = lambda x, y: F.coalesce(F.col(x), F.lit(0)) + F.coalesce(F.col(y), F.lit(0))
        return both.select("entity_id", "set_id", plus("_ha", "_sa").alias("_all"), plus("_hl", "_sl").alias("_labels"))


def _around(linked: Links, labels: DataFrame, hub: int | None = None) -> Around:
    hub = HUB if hub is None else hub
    sets = linked.members.groupBy("entity_id", "id").agg(F.sort_array(F.collect_set("mention_id")).alias("mentions"))
    sets = cut(sets.withColumn("set_id", F.sha2(F.to_json("mentions"), 256)))
    opened = cut(sets.select("entity_id", "set_id", "mentions").distinct().select("entity_id", "set_id", F.explode("mentions").alias("mention_id")))
    hubs = cut(opened.groupBy("entity_id", "mention_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hub).drop("_n"))
    held = opened.join(hubs, ["entity_id", "mention_id"]).groupBy("entity_id", "set_id").agg(F.sort_array(F.collect_set("mention_id")).alias("hubs"))
    held = cut(held.withColumn("hubs_id", F.sha2(F.to_json("hubs"), 256)))
    sets = cut(sets.join(held.select("entity_id", "set_id", "hubs_id"), ["entity_id", "set_id"], "left"))
    placed = cut(sets.select("entity_id", "id", "set_id", "hubs_id").join(labels, ["entity_id", "id"]).groupBy("entity_id", "set_id", "hubs_id", "label").agg(F.count(F.lit(1)).alias("n")))

    # Combinations of hubs that have one in common, and their nodes.
    combined = held.select("entity_id", "hubs_id", "hubs").distinct().select("entity_id", "hubs_id", F.explode("hubs").alias("mention_id"))
    near = combined.join(combined.withColumnRenamed("hubs_id", "near_id"), ["entity_id", "mention_id"]).select("entity_id", "hubs_id", "near_id").distinct()
    of_hubs = placed.filter("hubs_id IS NOT NULL").groupBy("entity_id", F.col("hubs_id").alias("near_id"), "label").agg(F.sum("n").alias("n"))
    by_hubs = near.join(of_hubs, ["entity_id", "near_id"]).groupBy("entity_id", "hubs_id", "label").agg(F.sum("n").alias("n"))

    # Sets that share a light mention, unless they share a hub as well.
    light = opened.join(hubs, ["entity_id", "mention_id"], "left_anti")
    pairs = light.join(light.withColumnRenamed("set_id", "near_id"), ["entity_id", "mention_id"]).select("entity_id", "set_id", "near_id").distinct()
    own = held.select("entity_id", "set_id", "hubs")
    pairs = pairs.join(own, ["entity_id", "set_id"], "left").join(own.withColumnsRenamed({"set_id": "near_id", "hubs": "near_hubs"}), ["entity_id", "near_id"], "left")
    pairs = pairs.filter(~F.coalesce(F.arrays_overlap("hubs", "near_hubs"), F.lit(False))).select("entity_id", "set_id", "near_id")
    by_set = pairs.join(placed.select("entity_id", F.col("set_id").alias("near_id"), "label", "n"), ["entity_id", "near_id"]).groupBy("entity_id", "set_id", "label").agg(F.sum("n").alias("n"))
    return Around(sets, cut(by_hubs), cut(by_set))


def analyse(linked: Links, sweeps: int = SWEEPS) -> DataFrame:
    """(entity_id, id, community, degree, inner, reached) per participant.

    Communities are the given node labels, or come from label propagation and
    are named after their smallest member. A neighbour counts once however it
    is reached; ``inner`` counts those of the own community, ``reached`` the
    communities among all of them.
    """
    if "label" in linked.nodes.columns:
        labels = linked.nodes.select("entity_id", "id", "label")
    else:
        raw = propagate(linked, sweeps)[0]
        smallest = raw.groupBy("entity_id", "label").agg(F.min("id").alias("_name"))
        labels = cut(raw.join(smallest, ["entity_id", "label"]).select("entity_id", "id", F.col("_name").alias("label")))
    around = _around(linked, labels)
    placed = labels.join(around.sets, ["entity_id", "id"], "left").join(around.totals(), ["entity_id", "set_id"], "left")
    nodes = cut(around.at(placed, "set_id", "hubs_id", "label", "_own"))
    # Relation neighbours that share no mention come on top.
    side = lambda p: nodes.select("entity_id", F.col("id").alias(p), F.col("label").alias(f"_{p}"), F.col("mentions").alias(f"_m{p}"), F.col("set_id").alias(f"_s{p}"), F.col("hubs_id").alias(f"_h{p}"))
    extra = linked.related.join(side("a"), ["entity_id", "a"]).join(side("b"), ["entity_id", "b"]).filter(~F.coalesce(F.arrays_overlap("_ma", "_mb"), F.lit(False)))
    extra = around.at(extra, "_sa", "_ha", "_b", "n")
    # The own label is reached by mentions only if another member holds it.
    fresh = F.when(F.coalesce(F.col("n"), F.lit(0)) <= F.when(F.col("_a") == F.col("_b"), 1).otherwise(0), F.col("_b"))
    more = extra.groupBy("entity_id", F.col("a").alias("id")).agg(
        F.count(F.lit(1)).alias("_more"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("_more_inner"), F.count_distinct(fresh).alias("_more_reached")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = F.when(F.col("set_id").isNotNull(), 1).otherwise(0)
    return nodes.join(more, ["entity_id", "id"], "left").select(
        "entity_id", "id", F.col("label").alias("community"), (zero("_all") - shares + zero("_more")).alias("degree"),
        (zero("_own") - shares + zero("_more_inner")).alias("inner"),
        (zero("_labels") - F.when(F.col("_own") == 1, 1).otherwise(0) + zero("_more_reached")).alias("reached"),
    )


def relabel(found: DataFrame) -> DataFrame:
    """Rename communities c0, c1, … by their smallest member."""
    smallest = found.groupBy("entity_id", "community").agg(F.min("id").alias("_min"))
    numbered = running_count(smallest, ["entity_id"], ["_min"], F.lit(1), "_n")
    names = numbered.select("entity_id", "community", F.concat(F.lit("c"), (F.col("_n") - 1).cast("string")).alias("name"))
    return found.join(names, ["entity_id", "community"]).withColumn("community", F.col("name")).drop("name")


def protection(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``protected``: named in the profile, or important enough."""
    side = facts.groupBy("entity_id", F.col("memory_id").alias("id")).agg(F.max("importance").alias("_importance"))
    out = nodes.join(side, ["entity_id", "id"], "left")
    return out.withColumn("protected", F.col("_importance").isNotNull() | (F.coalesce("_importance", F.lit(0.0)) >= IMPORTANCE_THRESHOLD)).drop("_importance")


def scores(members: DataFrame, now) -> DataFrame:
    """Activity per community from rows with confidence, times, inner, reached, protected."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    touched = F.greatest("last_accessed_at", "created_at")
    per = members.groupBy("entity_id", "community").agg(
        F.count(F.lit(1)).alias("size"), F.avg(clipped).alias("_confidence"), F.max(touched).alias("_touched"),
        F.sum("inner").alias("_inner"), F.avg(F.col("protected").cast("double")).alias("_protected"),
        F.count(F.when(F.col("protected"), 1)).alias("protected_members"), F.count(F.when(F.col("reached") >= 2, 1)).alias("bridges"),
    )
    fresh = F.coalesce(X.recency(X.days_between(X.at(now), F.col("_touched"))), F.lit(1.0))
    density = F.when(F.col("size") < 2, F.lit(0.0)).otherwise(F.col("_inner") / (F.col("size") * (F.col("size") - 1)))
    score = F.lit(0.3) * F.col("_confidence") + F.lit(0.3) * fresh + F.lit(0.2) * density + F.lit(0.2) * F.col("_protected")
    return per.withColumn("score", X.fixed(F.least(F.lit(1.0), score), 6)).select("entity_id", "community", "size", "score", "protected_members", "bridges")


def verdicts(scored: DataFrame, threshold: float = ACTIVITY_THRESHOLD) -> DataFrame:
    action = (
        F.when(F.col("score") >= threshold, "keep")
        .when(F.col("protected_members") > 0, "exempt_profile")
        .when(F.col("bridges") > 0, "exempt_bridge")
        .otherwise("forgotten")
    )
    return scored.withColumn("action", action)


def forgotten_members(members: DataFrame, decided: DataFrame) -> DataFrame:
    """Members of forgotten communities; of exempt bridges' ones all but the bridges."""
    joined = members.select("entity_id", "id", "community", "reached").join(decided.select("entity_id", "community", "action"), ["entity_id", "community"])
    gone = (F.col("action") == "forgotten") | ((F.col("action") == "exempt_bridge") & (F.col("reached") < 2))
    return joined.filter(gone).select("entity_id", "id")


def community_members(memories: DataFrame, edges: DataFrame, mention_edges: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Participants with community, link counts and protection."""
    pool = participants(memories, limit).select("entity_id", "id", "confidence", "created_at", "last_accessed_at")
    found = relabel(analyse(links(pool, edges, mention_edges)))
    return protection(pool.join(found, ["entity_id", "id"]), facts)
