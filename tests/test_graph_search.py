"""Walks, merges, communities, consolidation and vectors against brute force."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import communities, consolidate, graph, mentions, profile, relate, search, vectors

DAY = dt.datetime(2024, 1, 1)


def random_graph(seed, entities=6, size=14):
    rng = random.Random(seed)
    mem, edges, me = [], [], []
    for e in range(entities):
        ids = [f"e{e}m{i:02d}" for i in range(size)]
        for i, m in enumerate(ids):
            mem.append((f"e{e}", m, rng.random() < 0.75, DAY + dt.timedelta(hours=rng.randint(0, 9))))
            for k in range(rng.choice([0, 0, 1, 2])):
                me.append((f"e{e}", m, f"e{e}t{rng.randint(0, 4)}", DAY + dt.timedelta(hours=rng.randint(0, 9))))
        for _ in range(size):
            a, b = rng.sample(ids, 2)
            edges.append((f"e{e}", a, b, rng.choice(graph.RELATIONS), DAY + dt.timedelta(minutes=rng.randint(0, 99))))
    return mem, edges, me


def bfs(seeds, mem, edges, me, depth):
    latest = {m[1]: m[2] for m in mem}
    made = {m[1]: m[3] for m in mem}
    visited, found = set(seeds), {}
    frontier = [(s, f"memory:{s}") for s in seeds]
    links = {}
    for _, m, t, at in me:
        links[m, t] = min(at, links.get((m, t), at))
    for level in range(1, depth + 1):
        nxt = []
        for node, path in frontier:
            for at, t in sorted((at, t) for (m, t), at in links.items() if m == node):
                sib = sorted((m for (m, x) in links if x == t and latest[m]), key=lambda m: (-made[m].timestamp(), m))
                for m in sib:
                    if m not in visited:
                        visited.add(m)
                        found[m] = (level, f"{path} > mention:{t} > memory:{m}", False)
                        nxt.append((m, found[m][1]))
            near = [(at, r, b) for _, a, b, r, at in edges if a == node] + [(at, r, a) for _, a, b, r, at in edges if b == node]
            for at, r, other in sorted(near):
                old = not latest[other]
                if other in visited or (old and r != "UPDATES"):
                    continue
                visited.add(other)
                found[other] = (level, f"{path} > {r}:{other}", old)
                if not old:
                    nxt.append((other, found[other][1]))
        frontier = nxt
    return found


def test_walk_equals_sequential_search(spark):
    mem, edges, me = random_graph(11)
    M = spark.createDataFrame(mem, "entity_id string, id string, is_latest boolean, created_at timestamp")
    E = spark.createDataFrame(edges, "entity_id string, from_id string, to_id string, rel_type string, created_at timestamp")
    T = spark.createDataFrame(me, "entity_id string, memory_id string, mention_id string, created_at timestamp")
    seeds, want = [], {}
    for e in range(6):
        live = [m[1] for m in mem if m[0] == f"e{e}" and m[2]][:2]
        seeds += [(f"q{e}", f"e{e}", m, i + 1) for i, m in enumerate(live)]
        want |= {(f"q{e}", k): v for k, v in bfs(live, [m for m in mem if m[0] == f"e{e}"], [x for x in edges if x[0] == f"e{e}"], [x for x in me if x[0] == f"e{e}"], 4).items()}
    out = graph.walk(spark.createDataFrame(seeds, "query_id string, entity_id string, id string, position int"), M, E, T, 9)
    got = {(r.query_id, r.id): (r.depth, r.p, r.historical) for r in out.select("query_id", "id", "depth", "historical", graph.path_text().alias("p")).collect()}
    assert got == want
    assert graph.walk(spark.createDataFrame(seeds, "query_id string, entity_id string, id string, position int"), M, E, T, 0).count() == 0


def merge_one(rows, k):
    kept, texts, prev = [], {}, None
    for ident, content, score, source, depth, latest in sorted(rows, key=lambda r: (-r[2], r[4], r[0], r[3])):
        key = content.strip().lower()
        if ident in [x[0] for x in kept] or texts.get(key, source) != source:
            continue
        if len(kept) >= min(k, 3 if k <= 5 else 2) and prev is not None and prev - score > 0.15 and latest:
            break
        texts[key] = source
        kept.append((ident, source))
        prev = score
        if len(kept) == k:
            break
    return kept


def test_merge_equals_sequential(spark):
    rng = random.Random(2)
    rows, sizes = [], {}
    for q in range(40):
        sizes[f"q{q}"] = rng.choice([1, 3, 5, 9])
        for i in range(rng.randint(1, 16)):
            source = rng.choice(["memory", "rag", "fast_lane"])
            rows.append((f"q{q}", "e", f"{source}{i}", rng.choice(["A", " a ", "b", "c", "d", "e"]), rng.randint(0, 20) / 20, source, rng.randint(0, 2), rng.random() < 0.8))
    df = spark.createDataFrame(rows, "query_id string, entity_id string, id string, content string, score double, source string, depth int, is_latest boolean").withColumn("path", F.array().cast(search.PATH_TYPE))
    out = search.merge_results(df, spark.createDataFrame(list(sizes.items()), "query_id string, k int"))
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.source))
    for q, k in sizes.items():
        assert got[q] == merge_one([r[2:] for r in rows if r[0] == q], k), q


def test_vector_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    vecs = [(f"e{i % 2 if i % 5 else 0}", f"v{i:04d}", [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [("e0", "vzero", [0.0] * 8)]
    asks = [(f"q{i}", f"e{i % 2}", [float(x) for x in rng.normal(size=8)]) for i in range(21)]
    V = spark.createDataFrame(vecs, "entity_id string, chunk_id string, embedding array<float>")
    Q = spark.createDataFrame(asks, "query_id string, entity_id string, embedding array<float>")
    for block in (7, 512):
        got = {}
        for r in vectors.vector_top_k(Q, V, 6, block=block).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
        for q, e, x in asks:
            x = np.array(x, dtype=np.float32).astype(float)
            want = []
            for ve, vid, v in vecs:
                v = np.array(v, dtype=np.float32).astype(float)
                norm = np.linalg.norm(x) * np.linalg.norm(v)
                if ve == e:
                    want.append((-round(float(x @ v / norm) if norm else 0.0, 9), vid))
            assert sorted(got[q]) == sorted(want)[:6]


def sweep(ids, near, groups):
    """Two half steps per sweep, by hash of id; own label, neighbours and mentions vote."""
    half = {i: hashlib.md5(i.encode()).hexdigest()[0] < "8" for i in ids}
    best = lambda said: min(set(said), key=lambda x: (-said.count(x), x))
    groups = {t: g for t, g in groups.items() if len(g) > 1}
    labels = {i: i for i in ids}
    for _ in range(60):
        before = dict(labels)
        for turn in (True, False):
            spoken = {t: best([labels[i] for i in g]) for t, g in groups.items()}
            new = {i: best([labels[i], *[labels[j] for j in near[i]], *[spoken[t] for t, g in groups.items() if i in g]]) for i in ids if half[i] == turn}
            labels.update(new)
        if labels == before:
            break
    return labels


def shape(name, n, pairs, groups=()):
    """Edges and memberships of a small graph, ids numbered within it."""
    ident = lambda i: f"{name}{i:02d}"
    return (
        [(name, ident(i)) for i in range(n)], [(name, ident(a), ident(b), "EXTENDS", DAY) for a, b in pairs],
        [(name, ident(i), f"{name}-t{k}", DAY) for k, g in enumerate(groups) for i in g],
    )


def frames(spark, nodes, edges, me):
    return communities.links(
        spark.createDataFrame(nodes, "entity_id string, id string"),
        spark.createDataFrame(edges, "entity_id string, from_id string, to_id string, rel_type string, created_at timestamp"),
        spark.createDataFrame(me, "entity_id string, memory_id string, mention_id string, created_at timestamp"),
    )


@pytest.mark.parametrize("hub", [200, 2, 0])
def test_communities_equal_half_step_replay(spark, monkeypatch, hub):
    monkeypatch.setattr(communities, "HUB", hub)
    mem, edges, me = random_graph(4, 12, 16)
    nodes = [(m[0], m[1]) for m in mem if m[2]]
    cliques = [(a, b) for o in (0, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)]
    shapes = [
        shape("pair", 2, [(0, 1)]), shape("chain", 4, [(0, 1), (1, 2), (2, 3)]), shape("star", 5, [(0, i) for i in range(1, 5)]), shape("cycle", 4, [(0, 1), (1, 2), (2, 3), (0, 3)]),
        shape("alone", 1, []), shape("cliques", 11, [*cliques, (0, 10), (5, 10)]), shape("mention", 6, [], [range(6)]),
    ]
    for n, e, m in shapes:
        nodes, edges, me = nodes + n, edges + e, me + m
    linked = frames(spark, nodes, edges, me)
    got = {r.id: (r.community, r.degree, r.inner, r.reached) for r in communities.relabel(communities.analyse(linked)).collect()}
    assert communities.propagate(linked)[1]
    for e in {n[0] for n in nodes}:
        ids = sorted(i for x, i in nodes if x == e)
        near = {i: set() for i in ids}
        groups = {}
        for _, a, t, _ in me:
            if a in near:
                groups.setdefault(t, set()).add(a)
        for _, a, b, _, _ in edges:
            if a in near and b in near and a != b:
                near[a].add(b), near[b].add(a)
        labels = sweep(ids, near, groups)
        for g in groups.values():
            for a in g:
                near[a] = near[a] | g - {a}
        order = sorted({labels[i] for i in ids}, key=lambda x: min(i for i in ids if labels[i] == x))
        want = {i: f"c{order.index(labels[i])}" for i in ids}
        for i in ids:
            assert got[i] == (want[i], len(near[i]), sum(want[j] == want[i] for j in near[i]), len({want[j] for j in near[i]})), (e, i)
    count = lambda e: len({v[0] for k, v in got.items() if k.startswith(e)})
    assert [count(s) for s in ("pair", "chain", "star", "cycle", "alone", "cliques", "mention")] == [1, 1, 1, 1, 1, 2, 1]


def test_a_hub_mention_costs_no_pairs(spark):
    """20,000 memories share one mention and hold one of their own: linear rows, exact degrees."""
    n = 20_000
    nodes = spark.range(n).select(F.lit("e").alias("entity_id"), F.format_string("m%05d", "id").alias("id"), F.format_string("c%d", F.col("id") % 50).alias("part"))
    me = nodes.select("entity_id", F.col("id").alias("memory_id"), F.explode(F.array(F.lit("hub"), F.concat(F.lit("own-"), "id"))).alias("mention_id"))
    edges = spark.createDataFrame([("e", "m00000", "m00001", "EXTENDS", DAY)], "entity_id string, from_id string, to_id string, rel_type string, created_at timestamp")
    linked = communities.links(nodes, edges, me, "part")
    around = communities._around(linked, linked.nodes)
    assert around.by_hubs.count() == 50 and around.by_set.count() == 0
    found = communities.analyse(linked).groupBy("degree", "inner", "reached").count().collect()
    assert [tuple(r) for r in found] == [(n - 1, n // 50 - 1, 50, n)]


def test_communities_have_no_bound_per_entity(spark):
    """One entity above every earlier cap: 1,500 memories in a ring of cliques of five."""
    n = 1500
    pairs = [(a, b) for o in range(0, n, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)]
    found = communities.relabel(communities.analyse(frames(spark, *shape("big", n, pairs)))).collect()
    assert len(found) == n and len({r.community for r in found}) == n // 5 and {r.degree for r in found} == {4}


def test_edge_rewrite_equals_one_by_one(spark):
    rng = random.Random(8)
    merged, edges, want = [], [], set()
    for e in range(60):
        ids = [f"e{e}n{i}" for i in range(9)]
        rng.shuffle(ids)
        groups = [sorted(ids[:4]), sorted(ids[4:7])]
        mine = []
        for g in groups:
            rep = rng.choice(g)
            mine += [(f"e{e}", i, rep, g[0]) for i in g if i != rep and rng.random() < 0.8]
        links = [(*rng.sample(ids, 2), rng.choice(graph.RELATIONS)) for _ in range(8)]
        merged += mine
        edges += [(f"e{e}", *x) for x in links]
        now = list(links)
        for _, i, rep, _ in sorted(mine, key=lambda m: (m[3], m[1])):
            out = []
            for a, b, r in now:
                if r != "UPDATES" and i in (a, b) and rep not in (a, b):
                    a, b = (rep if a == i else a), (rep if b == i else b)
                out.append((a, b, r))
            now = out
        want |= {(f"e{e}", n, *x) for n, x in enumerate(now)}
    M = spark.createDataFrame(merged, "entity_id string, id string, representative string, label string")
    numbered = [(x[0], n % 8, *x[1:]) for n, x in enumerate(edges)]
    E = spark.createDataFrame(numbered, "entity_id string, n int, from_id string, to_id string, rel_type string")
    got = {tuple(r) for r in consolidate.rewrite_relations(E, M).collect()}
    assert got == want


def test_components_on_a_long_chain(spark):
    pairs = [("e", f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("f", "b", "a"), ("f", "b", "c"), ("g", "x", "y")]
    got = {(r.entity_id, r.id): r.label for r in graph.components(spark.createDataFrame(pairs, "entity_id string, a string, b string")).collect()}
    assert {v for (e, _), v in got.items() if e == "e"} == {"n000"}
    assert got["f", "c"] == "a" and got["g", "y"] == "x"


def test_mentions_by_case_and_bounds(spark):
    gaz = spark.createDataFrame([(0, "rust", "Rust", "product"), (1, "vs code", "VS Code", "technology"), (2, "谷歌", "Google", "organization"), (3, "google", "Google", "organization"), (4, "c++", "C++", "technology")], "ord int, key string, canonical string, type string")
    texts = [("e", "a", "I trust RUST and Vs Code"), ("e", "b", "trusty rusty"), ("e", "c", "在谷歌工作, google!"), ("e", "d", "C++ x"), ("e", "f", "")]
    df = spark.createDataFrame(texts, "entity_id string, memory_id string, content string").withColumn("created_at", F.lit(DAY))
    found = mentions.extract_mentions(df, gaz)
    got = [(r.memory_id, r.surface_form, r.canonical_form) for r in found.orderBy("memory_id", "position", "ord").collect()]
    assert got == [("a", "RUST", "Rust"), ("a", "Vs Code", "VS Code"), ("c", "谷歌", "Google"), ("c", "google", "Google"), ("d", "C++", "C++")]
    edges = mentions.attach_mentions(found)
    node = {r.canonical_form: r for r in mentions.mention_nodes(edges).collect()}
    assert node["Google"].mention_count == 2 and sorted(node["Google"].aliases) == ["google", "谷歌"]
    assert node["Rust"].type == "technology"


def test_lineage_on_a_cycle_ends(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("t", "u"), ("u", "v")]  # newer, older
    edges = spark.createDataFrame([("e", x, y, "UPDATES", DAY) for x, y in pairs], "entity_id string, from_id string, to_id string, rel_type string, created_at timestamp")
    got = {r.id: (r.newest, r.steps) for r in graph.update_lineage(edges).collect()}
    assert got == {"a": (None, None), "b": (None, None), "c": (None, None), "t": ("t", 0), "u": ("t", 1), "v": ("t", 2)}


def test_more_copies_than_any_cap_consolidate(spark):
    """1,500 copies of one fact, and some near it, merge into the one that stands for them."""
    n = 1500
    rows = [("e", f"m{i:05d}", "same fact", "fact", 0.3 + (i == 777) * 0.4, True, DAY + dt.timedelta(minutes=i % 7)) for i in range(n)] + [("e", "z1", "near", "fact", 0.2, True, DAY), ("e", "y1", "far", "fact", 0.2, True, DAY)]
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, memory_type string, confidence double, is_latest boolean, created_at timestamp").withColumns(
        {"provenance": F.lit("explicit_statement"), "validation_count": F.lit(0), "contradiction_detected": F.lit(False)})
    vec = lambda i: [0.0, 1.0] if i == "y1" else [1.0, 0.3] if i == "z1" else [1.0, 0.0]
    vecs = spark.createDataFrame([("e", r[1], None, vec(r[1])) for r in rows], "entity_id string, chunk_id string, document_id string, embedding array<float>")
    pairs = consolidate.candidate_pairs(memories, vecs, "2024-02-01 00:00:00").collect()
    assert len(pairs) == n - 1 + n  # every copy with the head, and with the near one
    assert sum("m00777" in (p.a, p.b) for p in pairs) == n and not any("y1" in (p.a, p.b) for p in pairs)


def merges_by_hand(rows, near, protected, updates, contradicts):
    """All pairs judged, components, and members whose own pair with the representative merges."""
    good = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1:]:
            fine = near(x, y) and x[3] == y[3] and not {x[1], y[1]} & protected and not contradicts(x[2], y[2])
            if fine and (x[1], y[1]) not in updates and (y[1], x[1]) not in updates:
                good.add(frozenset((x[1], y[1])))
    label = {r[1]: r[1] for r in rows}
    for _ in rows:
        for p in good:
            low = min(label[i] for i in p)
            label |= {k: low for k, v in label.items() if v in {label[i] for i in p}}
    out = set()
    for name in set(label.values()):
        group = sorted((r for r in rows if label[r[1]] == name), key=lambda r: (-r[4], -r[6].timestamp(), r[1]))
        out |= {(r[1], group[0][1]) for r in group[1:] if frozenset((r[1], group[0][1])) in good}
    return out


def consolidation_case(spark, rows, vec, protected, updates):
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, memory_type string, confidence double, is_latest boolean, created_at timestamp").withColumns(
        {"provenance": F.lit("explicit_statement"), "validation_count": F.lit(0), "contradiction_detected": F.lit(False)})
    vecs = spark.createDataFrame([("e", r[1], None, vec(r)) for r in rows], "entity_id string, chunk_id string, document_id string, embedding array<float>")
    facts = spark.createDataFrame([("e", i, 0.9) for i in protected], "entity_id string, memory_id string, importance double")
    edges = spark.createDataFrame([("e", x, y, "UPDATES") for x, y in updates], "entity_id string, from_id string, to_id string, rel_type string")
    now = "2024-02-01 00:00:00"
    pairs = consolidate.candidate_pairs(memories, vecs, now, 0.9, edges, facts)
    judged = consolidate.judge_pairs(pairs, memories, edges, facts, now)
    return {(r.id, r.representative) for r in consolidate.merges(judged, consolidate.representatives(judged)).collect()}


def test_copies_of_a_protected_head_merge(spark):
    rows = [("e", f"m{i}", "Nora likes tea", "fact", 0.9 - i / 10, True, DAY) for i in range(4)]
    assert consolidation_case(spark, rows, lambda r: [1.0, 0.0], {"m0"}, []) == {("m2", "m1"), ("m3", "m1")}
    assert consolidation_case(spark, rows, lambda r: [1.0, 0.0], set(), [("m0", "m1")]) == {("m2", "m0"), ("m3", "m0")}


def test_merges_equal_those_of_all_pairs(spark):
    rng = random.Random(12)
    texts = ["Nora likes tea", "Nora likes green tea", "Nora weighs 62kg", "Nora weighs 66kg", "用户不喜欢开会", "用户喜欢开会吗"]
    rows = [("e", f"m{i:02d}", rng.choice(texts), rng.choice(["fact", "fact", "preference"]), round(rng.random(), 2), True, DAY + dt.timedelta(minutes=rng.randrange(5))) for i in range(60)]
    angle = {r[1]: rng.choice([0.0, 0.0, 0.2, 0.4, 0.6, 2.0]) for r in rows}
    vec = lambda r: [math.cos(angle[r[1]]), math.sin(angle[r[1]])]
    near = lambda x, y: math.cos(angle[x[1]] - angle[y[1]]) >= 0.9
    protected = {r[1] for r in rows if rng.random() < 0.15}
    updates = {(a[1], b[1]) for a, b in (rng.sample(rows, 2) for _ in range(25))}
    side = lambda p: relate.text_features(spark.createDataFrame([(t,) for t in texts], "content string")).select(F.col("content").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in relate._SIDE])
    veto = {(r.n, r.o) for r in relate.contradicts(side("n").crossJoin(side("o")), "hit").filter("hit").select("n", "o").collect()}
    contradicts = lambda x, y: (x, y) in veto or (y, x) in veto
    assert consolidation_case(spark, rows, vec, protected, updates) == merges_by_hand(rows, near, protected, updates, contradicts)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_recall_of_near_pairs(spark, least):
    """Of the pairs at or above the threshold, nine of ten and more are found, and no other."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    vecs = np.array([r.embedding for r in rows], dtype=np.float64)
    rng = np.random.default_rng(1)
    vecs = np.concatenate([vecs, vecs[:100] + rng.normal(0, 0.04, vecs[:100].shape)])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= least, 1)), strict=True)}
    df = spark.createDataFrame([("e", f"v{i:04d}", v.tolist()) for i, v in enumerate(vecs)] + [("e", "zero", [0.0] * vecs.shape[1]), ("e", "none", None)], "entity_id string, vid string, vec array<double>")
    got = {(r.a, r.b) for r in vectors.near_pairs(df, least).collect()}
    assert got <= want and len(want) >= 50 and len(got) >= 0.95 * len(want)


def test_profiles_read_more_than_any_cap(spark):
    """The most important fact of an entity is found below 1,500 newer ones."""
    rows = [("e", f"m{i:05d}", f"fact {i}", "fact", 1.0 if i == 0 else 0.6, True, DAY + dt.timedelta(minutes=i)) for i in range(1500)]
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, memory_type string, confidence double, is_latest boolean, created_at timestamp").withColumns(
        {"provenance": F.lit("explicit_statement"), "validation_count": F.lit(0), "contradiction_detected": F.lit(False), "valid_until": F.lit(None).cast("timestamp"), "internal_type": F.lit(None).cast("string")})
    facts = profile.profile_facts(memories, None, "2024-02-01 00:00:00")
    assert facts.filter("rank = 1").first().memory_id == "m00000"
    assert profile.profile_summary(memories, facts, "2024-02-01 00:00:00").first().memory_count == 1500
    assert "Total memories: 1500" in profile.digest(facts, memories, "2024-02-01 00:00:00").first().digest


def test_near_pairs_are_exact(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((600, 16))
    far = np.tan(np.arccos(0.9001))
    for n, v in enumerate(base):
        v /= np.linalg.norm(v)
        if n % 2:  # right at the threshold of its predecessor
            w = v - (v @ base[n - 1]) * base[n - 1]
            base[n] = base[n - 1] + far * w / np.linalg.norm(w)
    rows = [("e", f"v{n:04d}", [float(x) for x in v]) for n, v in enumerate(base)] + [("e", "zero", [0.0] * 16), ("e", "short", [1.0, 2.0]), ("f", "v0000", [float(x) for x in base[0]])]
    df = spark.createDataFrame(rows, "entity_id string, vid string, vec array<float>")
    unit = base.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(f"v{a:04d}", f"v{b:04d}") for a, b in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 9) >= 0.9, 1)))}
    assert len(want) >= 300
    for size in (vectors.NEAR_BLOCK, 70):
        got = [(r.a, r.b) for r in vectors.near_pairs(df, 0.9, block=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_that_meet_the_same_queries_pass_on_k_hits_together():
    rng = np.random.default_rng(5)
    queries, vecs = rng.standard_normal((7, 4)), rng.standard_normal((60, 4))
    vecs[40:] = vecs[:20]  # equal scores go by id
    names = [f"q{n}" for n in range(7)]
    rows = [("e", names, queries.ravel(), [f"v{n:02d}" for n in range(at, at + 12)], vecs[at : at + 12].ravel()) for at in range(0, 60, 12)]
    batches = [pd.DataFrame(part, columns=["entity_id", "q_ids", "q_vecs", "v_ids", "v_vecs"]) for part in (rows[:2], rows[2:])]
    out = pd.concat(vectors._compare(5, None)(iter(batches)))
    assert len(out) == 7 * 5
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(vecs).T, 9)
    for n, name in enumerate(names):
        want = sorted(((-scores[n, m], f"v{m:02d}") for m in range(60)))[:5]
        got = out[out["query_id"] == name]
        assert [c for _, c in want] == list(got["chunk_id"]) and np.allclose([-x for x, _ in want], got["score"])


def test_terms_meet_words_on_few_pieces(spark):
    """A word is listed under three characters in a row, and short terms are asked of texts."""
    texts = ["the Cat sat, cats!", "a x9 concat 北京", "catapult über", "", None]
    memories = spark.createDataFrame([("e", f"m{i}", t) for i, t in enumerate(texts)], "entity_id string, id string, content string")
    terms = ["a", "t", "x9", "at", "cat", "cats", "the", "京", "apul", "zzz"]
    hits = search._term_hits(spark.createDataFrame([("e", t) for t in terms], "entity_id string, term string"), memories)
    assert sorted((r.term, r.id) for r in hits.collect()) == sorted((t, f"m{i}") for t in terms for i, x in enumerate(texts) if t in (x or "").lower())
    assert memories.limit(1).select(search._pieces(F.lit("catapults"))).first()[0] == ["cat", "ata", "tap", "apu", "pul", "ult", "lts"]


def test_trigrams_of_padded_words(spark):
    texts = ["The cat; the CAT sat on a mat", "a", "!!", "über 北京 x9", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.trigrams(F.col("t")).alias("g")).collect()
    for r in got:
        words = re.findall(r"[^\W_]+", r.t.lower())
        assert len(r.g) == len(set(r.g)) and set(r.g) == {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}
