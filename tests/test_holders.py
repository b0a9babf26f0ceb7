"""The newest live holders of bigrams, against a replay in plain Python."""

import datetime as dt
import random
import sys

import pytest

from factloom.operators import holders, relate
from factloom.session import cut


@pytest.mark.parametrize("nested", [False, True])
def test_newest_holders_equal_replay_over_blocks(spark, monkeypatch, nested):
    """Lifetimes of any length, blocks of a few positions; nested ones end in the reverse order they began."""
    monkeypatch.setattr(holders, "LEAST", 5)
    rng, rows = random.Random(59), []
    for entity, count in (("a", 160), ("b", 43), ("c", 1)):
        for seq in range(1, count + 1):
            end = count - seq // 2 if nested else rng.choice([None, seq - 3, seq, seq + 2, seq + 9, seq + 60, count])
            rows.append((entity, seq, rng.sample(range(40), rng.randint(0, 4)), end, rng.random() < 0.8))
    df = spark.createDataFrame(rows, "entity_id string, seq bigint, codes array<bigint>, end bigint, asks boolean")
    found = holders.newest_holders(df, df.select("entity_id", "seq", "end"), df.filter("asks"), 3, codes=12)
    got = {(r.entity_id, r.seq): (r.covered, r.olds) for r in found.collect()}
    want = {}
    for entity, seq, codes, _, asks in rows:
        if asks and codes:
            alive = [(o[1], set(o[2])) for o in rows if o[0] == entity and o[1] < seq and (o[3] is None or seq <= o[3])]
            olds = sorted((s for s, held in alive if held & set(codes)), reverse=True)[:3]
            want[entity, seq] = (sum(any(c in held for _, held in alive) for c in codes), olds)
    assert got == want


def test_sources_are_found_without_listing_bigrams(spark, monkeypatch):
    """No table on the way has a row per bigram of a text."""
    rng, day, sizes = random.Random(61), dt.datetime(2024, 1, 1), []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    for name, module in list(sys.modules.items()):
        if name.startswith("factloom.operators.") and hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", counted)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(150)]
    rows = [("e", f"m{n:04d}", t, day + dt.timedelta(minutes=n), None, True, "fact", None, 0.5) for n, t in enumerate(texts)]
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, created_at timestamp, valid_until timestamp, is_latest boolean, memory_type string, internal_type string, confidence double")
    got = {(r.from_id, r.to_id) for r in relate.infer(memories).derives.collect()}
    grams, want = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts], set()
    for n in range(2, len(texts)):
        if grams[n] - set().union(*grams[:n]):
            want |= {(f"m{n:04d}", f"m{o:04d}") for o in [o for o in range(n - 1, -1, -1) if grams[n] & grams[o]][:3]}
    assert got == want
    assert max(sizes) < 20_000


def test_blocks_are_sent_by_groups(spark, monkeypatch):
    """A block goes once to a group of those it meets, not to each of them."""
    from factloom.operators import overlap

    monkeypatch.setattr(overlap, "DENSE", 8)
    monkeypatch.setattr(overlap, "SHORTEST", 8)
    rows = [("e", n, [n % 7, 100 + n % 5, 200 + n % 3]) for n in range(1, 801)]
    texts = spark.createDataFrame(rows, "entity_id string, seq bigint, codes array<bigint>")
    for name, kind in (("singles", "bigint"), ("pairs", "bigint"), ("subjects", "string")):
        texts = texts.selectExpr("*", f"CAST(array() AS array<{kind}>) AS {name}")
    asks = spark.range(1, 801).selectExpr("'e' AS entity_id", "id AS seq", "id + 1 AS first", "800L AS last")
    blocks, sent, frame = overlap.Blocks(texts, ["seq"]), [], type(texts)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, real=frame.mapInArrow: (sent.append(self.count()), real(self, *a))[1])
    found = blocks.pairs(asks, None, ["n_seq", "o_seq", "shared"])
    common = lambda n, o: len(set(n[2]) & set(o[2]))
    want = {(n[1], o[1], common(n, o)) for n in rows for o in rows if o[1] < n[1] and common(n, o) >= 2}
    assert {(r.n_seq, r.o_seq, r.shared) for r in found.collect()} == want
    assert sum(sent) < 2500


def test_edges_that_lie_by_entity_are_not_shuffled(spark, tmp_path):
    from factloom.streaming.store import FactStore

    store = FactStore(spark, str(tmp_path), spark.createDataFrame([], "entity_id string, id string").schema)
    store.create()
    edges = spark.range(0, 300_000, 1, 4).selectExpr("'e' AS entity_id", "md5(CAST(id AS string)) AS from_id", "md5(CAST(id + 1 AS string)) AS to_id", "'EXTENDS' AS rel_type", "timestamp '2024-01-01' AS created_at")
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(status.executorList(False).apply(i).totalShuffleWrite() for i in range(status.executorList(False).size()))
    before = written()
    store.append(edges.limit(5), "edges", 0, lying=edges)
    assert store.log("edges", -1, 0).count() == 300_005
    assert written() - before < 1_000_000
