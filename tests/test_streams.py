"""Streams over several micro-batches."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from factloom.operators import lifecycle, profile, relate
from factloom.streaming import streams
from factloom.streaming.store import FactStore

T0 = dt.datetime(2024, 1, 1)


def run_batches(spark, tmp_path, schema, batches, build, mode="append"):
    """Feed the batches as files, one per micro-batch."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/part{i}")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    return streams.run_available(build(raw), spark, str(tmp_path / "out"), str(tmp_path / "ckpt"), mode)


def test_adds_are_idempotent_for_an_hour(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.TIMER_STORE)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("e", "k1", at(0)), ("e", "k2", at(5)), ("e", "k2", at(64)), ("e", "k2", at(65))], [("e", "k1", at(59)), ("e", "k1", at(60)), ("e", "k1", at(119))], [("e", "k3", at(300))], [("e", "k4", at(301))], [("e", "k1", at(310))]]
    out = run_batches(spark, tmp_path, "entity_id string, key string, ts timestamp", batches, lambda s: streams.idempotent_adds(s, ["entity_id", "key"]))
    got = sorted((r.key, r.ts) for r in out.collect())
    assert got == [("k1", at(0)), ("k1", at(60)), ("k1", at(310)), ("k2", at(5)), ("k2", at(65)), ("k3", at(300)), ("k4", at(301))]


def lane_by_hand(rows, hours=24):
    """Marks of one document after another, event by event."""
    out, newest = [], max(t for _, _, t in rows)
    ms = lambda t: int(t.timestamp() * 1000)
    for d in {r[0] for r in rows}:
        born = None
        for _, kind, t in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1] == "indexed")):
            if born is not None and t >= born + dt.timedelta(hours=hours):
                out.append((d, "retired_age", ms(born + dt.timedelta(hours=hours))))
                born = None
            if kind == "indexed" and born is not None:
                out.append((d, "retired_indexed", ms(t)))
                born = None
            elif kind == "raw" and born is None:
                born = t
                out.append((d, "live", ms(t)))
        if born is not None and born + dt.timedelta(hours=hours) <= newest:
            out.append((d, "retired_age", ms(born + dt.timedelta(hours=hours))))
    return sorted(out)


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    """One file and six files in order of time give the same rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.TIMER_STORE)
    rng = random.Random(5)
    rows = sorted(((f"d{rng.randrange(12)}", rng.choice(["raw", "raw", "indexed"]), T0 + dt.timedelta(minutes=rng.randrange(6000), milliseconds=i)) for i in range(400)), key=lambda r: r[2])
    schema = "document_id string, kind string, ts timestamp"
    per = [rows[i : i + 70] for i in range(0, 400, 70)]
    want = []
    for k in {r[:2] for r in rows}:
        last = None
        for _, _, t in (r for r in rows if r[:2] == k):
            if last is None or t >= last + dt.timedelta(hours=1):
                want.append((*k, t))
                last = t
    for name, batches in (("one", [rows]), ("many", per)):
        adds = run_batches(spark, tmp_path / f"a{name}", schema, batches, lambda s: streams.idempotent_adds(s, ["document_id", "kind"]))
        assert sorted(tuple(r) for r in adds.collect()) == sorted(want)
        marks = run_batches(spark, tmp_path / f"l{name}", schema, batches, streams.fast_lane_changes)
        assert sorted(tuple(r) for r in marks.collect()) == lane_by_hand(rows)


def test_ingest_over_two_batches_and_replay(spark, tmp_path):
    schema = "entity_id string, id string, content string, created_at timestamp, valid_until timestamp, memory_type string, internal_type string, confidence double, is_latest boolean, provenance string, validation_count int, contradiction_detected boolean"
    row = lambda i, text: ("e", f"m{i}", text, T0 + dt.timedelta(hours=i), None, "fact", None, 0.9, True, "explicit_statement", 0, False)
    texts = ["Nina 住在 北京", "Nina 喜欢喝茶", "Nina 住在 上海", "Nina 住在 杭州", "Nina 喜欢喝绿茶"]
    rows = [row(i, t) for i, t in enumerate(texts)]
    frame = lambda part: spark.createDataFrame(part, schema)
    sink = streams.ingest_sink(str(tmp_path / "store"), "2024-01-02 00:00:00", buckets=4)
    store = FactStore(spark, str(tmp_path / "store"), frame([]).schema, buckets=4)
    sink(frame(rows[:3]), 0)
    whole = {r.id: r.replaced_by for r in relate.infer(frame(rows)).superseded.collect()}
    for folded in (-1, 1):  # the second call is a replay of a batch that a base already holds
        if folded >= 0:
            store.compact(folded)
        sink(frame(rows[2:]), 1)
        stored = {r.id: (r.is_latest, r.replaced_by) for r in store.memories(1).collect()}
        assert stored == {f"m{i}": (f"m{i}" not in whole, whole.get(f"m{i}")) for i in range(5)} and whole["m0"] == "m2" and whole["m2"] == "m3"
        assert sorted(r.memory_id for r in store.facts(1).collect()) == sorted({"m1", "m3", "m4"} - set(whole))
        assert sorted(map(tuple, store.edges(1).drop("created_at").collect())) == sorted(map(tuple, relate.infer(frame(rows)).edges.drop("created_at").collect()))


def test_a_batch_writes_and_reads_what_it_touches(spark, tmp_path):
    schema = "entity_id string, id string, content string, created_at timestamp, valid_until timestamp, memory_type string, internal_type string, confidence double, is_latest boolean, provenance string, validation_count int, contradiction_detected boolean"
    row = lambda e, i: (f"e{e}", f"m{e}-{i}", f"note {e} on item {i}", T0 + dt.timedelta(hours=i), None, "fact", None, 0.9, True, "explicit_statement", 0, False)
    frame = lambda part: spark.createDataFrame(part, schema)
    sink = streams.ingest_sink(str(tmp_path / "store"), "2024-01-02 00:00:00", buckets=8)
    sink(frame([row(e, i) for e in range(40) for i in range(10)]), 0)
    sink(frame([row(3, 11)]), 1)
    size = lambda table, batch: sum(f.stat().st_size for f in (tmp_path / "store/log" / table / f"store_batch={batch}").rglob("*.parquet"))
    folders = lambda table, batch: len(list((tmp_path / "store/log" / table / f"store_batch={batch}").glob("store_bucket=*")))
    assert folders("memories", 0) > 1 and folders("memories", 1) == folders("facts", 1) == 1
    assert size("facts", 1) < size("facts", 0)
    store = FactStore(spark, str(tmp_path / "store"), frame([]).schema, buckets=8)
    mine = frame([row(3, 0)]).select(store.bucket()).first()[0]
    plan = store.log("memories", -1, 1, [mine])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*store_bucket", plan)
    before = sorted(map(str, store.memories(1).collect())), sorted(map(str, store.facts(1).collect()))
    store.compact(1)
    assert store.base(1) == 1 and store.base(0) == -1
    assert before == (sorted(map(str, store.memories(1).collect())), sorted(map(str, store.facts(1).collect())))
    sink(frame([row(41, 0), row(3, 11)]), 2)  # a new entity, and an id that is known
    assert store.memories(2).count() == 402 and store.facts(2).filter("entity_id = 'e41'").count() == 1
    assert sorted(map(str, store.facts(2).filter("entity_id <> 'e41'").collect())) == before[1]


def test_maintenance_forgets_a_stale_clique_and_keeps_the_rest(spark):
    now = dt.datetime(2024, 6, 1)
    make = lambda ident, kind, days, conf: ("e", ident, f"text {ident}", kind, conf, now - dt.timedelta(days=days))
    stale = [make(f"s{i}", "observation", 120, 0.4) for i in range(5)]
    active = [make(f"t{i}", "observation", 1, 0.9) for i in range(5)]
    known = [make(f"p{i}", "fact", 100, 0.9) for i in range(3)]
    schema = "entity_id string, id string, content string, memory_type string, confidence double, created_at timestamp"
    m = spark.createDataFrame(stale + active + known, schema).withColumns({
        "is_latest": F.lit(True), "valid_until": F.lit(None).cast("timestamp"), "last_accessed_at": F.lit(None).cast("timestamp"),
        "provenance": F.lit("explicit_statement"), "validation_count": F.lit(0), "contradiction_detected": F.lit(False), "internal_type": F.lit(None).cast("string"),
        "expired_at": F.lit(None).cast("timestamp"), "updated_at": F.col("created_at"), "replaced_by": F.lit(None).cast("string"), "metadata": F.create_map().cast("map<string,string>"),
    })
    cliques = [("e", f"{p}{a}", f"{p}{b}", "EXTENDS", now) for p, n in (("s", 5), ("t", 5), ("p", 3)) for a in range(n) for b in range(a + 1, n)]
    edges = spark.createDataFrame(cliques, "entity_id string, from_id string, to_id string, rel_type string, created_at timestamp")
    me = spark.createDataFrame([("e", "s0", "x", "X", "concept", "x", 0.9, now), ("e", "s1", "x", "X", "concept", "x", 0.9, now), ("e", "t0", "y", "Y", "concept", "y", 0.9, now)],
                               "entity_id string, memory_id string, mention_id string, canonical_form string, type string, surface_form string, confidence double, created_at timestamp")
    from factloom.operators.mentions import mention_nodes
    vec = m.select("entity_id", F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("document_id"), F.col("content").alias("text"))
    from factloom.functions import exprs as X
    vec = vec.withColumn("embedding", X.hash_embedding(F.col("text"), 16))
    base = lifecycle.MemoryBase(m, edges, me, mention_nodes(me), vec)
    after, report = lifecycle.maintain(base, "2024-06-01 00:00:00")
    state = {r.id: (r.is_latest, r.replaced_by) for r in after.memories.collect()}
    assert {i for i, (live, _) in state.items() if not live} == {f"s{i}" for i in range(5)}
    assert {state[f"s{i}"][1] for i in range(5)} == {"community_forgotten"}
    assert {(r.mention_id, r.mention_count) for r in after.mentions.collect()} == {("y", 1)}
    again, second = lifecycle.maintain(after, "2024-06-01 00:00:00")
    assert {r.id: (r.is_latest, r.replaced_by) for r in again.memories.collect()} == state
    assert profile.profile_facts(after.memories, edges, "2024-06-01 00:00:00").filter("kind = 'static'").count() == 3


def test_maintenance_writes_texts_once(spark):
    """Texts of 1.2 MB that do not compress: between the steps their digests stand for them."""
    import hashlib
    import os

    from factloom.plans import catalog_lifecycle
    from factloom.plans.catalog_search import Tables
    from factloom.session import shared_dir

    t = Tables(spark, "/root/testdata/sf0.001")
    long = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(100))
    base = catalog_lifecycle._base(t)
    base.memories = base.memories.withColumn("content", F.concat("id", F.sha2("id", 512), F.lit(long))).filter("is_latest").limit(90).localCheckpoint()
    folder = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(r, f)) for r, _, names in os.walk(folder) for f in names)
    whole = spark.createDataFrame([(x.id, x.content) for x in base.memories.select("id", "content").collect()], "id string, content string")
    start = size()
    lifecycle.cut(whole)
    once = size() - start
    after, _ = lifecycle.maintain(base, "2024-02-01 00:00:00")
    assert sorted(x.content for x in after.memories.collect()) == sorted(x.content for x in whole.collect())
    assert size() - start - once < 2 * once + 1_000_000


def test_a_folder_of_parts_streams_like_one_file(spark, tmp_path):
    from factloom.plans import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.TIMER_STORE)
    for name in ("m1_idempotent_add", "m2_fast_lane_stream", "m3_source_events", "m3_binding_states"):
        rows = [sorted(map(tuple, catalog.queries()[name](spark, d).collect()), key=str) for d in ("/root/testdata/sf0.001", str(tmp_path))]
        assert rows[0] == rows[1] and rows[0]
