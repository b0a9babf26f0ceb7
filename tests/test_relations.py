"""Relation inference against a one-by-one replay in plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import ordering, relate
from factloom.operators.overlap import Blocks, Overlaps, contained_pairs
from factloom.session import cut, prepare

DAY = dt.datetime(2024, 1, 1)
CJK = "[一-鿿]"


def bigrams(text):
    s = re.sub(r"\s+", "", text)
    return {s[i:i + 2] for i in range(len(s) - 1)}


def subjects(text):
    out = set()
    if m := re.match(f"{CJK}+", text):
        out |= {m[0][0]} | ({m[0][:2]} if len(m[0]) > 1 else set())
    if m := re.match("[A-Z][a-zA-Z]+", text):
        out.add(m[0])
    return out


def overlaps(n, o):
    a, b = bigrams(n), bigrams(o)
    return bool(a and b) and (len(a & b) >= 2 or bool(subjects(n) & subjects(o)))


def quantities(text):
    out = {}
    for num, unit in re.findall(rf"(\d+(?:\.\d+)?)\s*({X.UNITS})", text, re.I):
        out.setdefault(unit, set()).add(num)
    return out


def template(text):
    out = re.sub("|".join(map(re.escape, X.TEMPLATE_NAMES)), "*", text)
    return None if out == text else re.sub(r"\s*\*\s*", "*", out)


def fill(text):
    return re.findall(rf"{CJK}+|[A-Z][a-z]+(?:\+{{2}})?|[A-Z]{{2,}}", text)


def relation(n, o):
    if n.strip() == o.strip() or not overlaps(n, o):
        return "NONE"
    if re.search(X.FUTURE_WORDS, o, re.I) and re.search(X.COMPLETION_WORDS, n, re.I):
        return "UPDATES"
    qn, qo = quantities(n), quantities(o)
    if any(qn[u] != qo[u] for u in qn.keys() & qo.keys()):
        return "UPDATES"
    if template(n) and template(n) == template(o) and fill(n) and fill(o) and fill(n) != fill(o):
        return "UPDATES"
    shared = bigrams(n) & bigrams(o)
    if any(w in n for w in X.CHANGE_WORDS):
        return "UPDATES"
    if any(w in n for w in X.NEGATION_WORDS):
        who = subjects(n) | subjects(o)
        if len([b for b in shared if not any(b in s or s in b for s in who)]) >= 2:
            return "UPDATES"
    return "EXTENDS" if shared and bigrams(n) - bigrams(o) else "NONE"


def replay(rows, window):
    """rows in order: (id, content, created, until) → superseded, extends, derives."""
    live, gone, extends, derives = [], {}, set(), set()
    for ident, content, created, _ in rows:
        cands = [r for r in reversed(live) if r[0] not in gone and (r[3] is None or r[3] > created)][:window]
        used = []
        covered = set()
        for old in cands:
            kind = relation(content, old[1])
            if kind == "UPDATES":
                gone[old[0]] = ident
            elif kind == "EXTENDS":
                extends.add((ident, old[0]))
            both = bigrams(content) & bigrams(old[1])
            if both:
                used.append(old[0])
                covered |= both
        if len(used) >= 2 and covered != bigrams(content):
            derives |= {(ident, u) for u in used[:3]}
        live.append((ident, content, created, _))
    return gone, extends, derives


WORDS = ["用户住在北京", "用户住在上海", "用户住在 London 附近", "预算 10万", "预算 12万", "预算是 12 万", "明天开会", "开会结束", "用户不喜欢开会", "用户喜欢开会吗",
         "用户现在喝茶", "茶很好喝的", "Nora likes tea", "Nora likes green tea", "Nora", "x", "ab ab ab", "abab cd", "天气晴", "天气不晴朗的日子"]


def corpus(seed, entities, size):
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        for i in range(rng.randint(1, size)):
            text = rng.choice(WORDS) + rng.choice(["", "", " 了", str(rng.randint(1, 3))])
            created = DAY + dt.timedelta(hours=rng.randint(0, size))
            until = created + dt.timedelta(hours=rng.randint(1, 30)) if rng.random() < 0.25 else None
            rows.append((f"e{e}", f"m{i:03d}", text, created, until))
    return rows


SCHEMA = "entity_id string, id string, content string, created_at timestamp, valid_until timestamp"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({
        "is_latest": F.lit(True), "memory_type": F.when(F.crc32("content") % 2 == 0, "preference").otherwise("fact"),
        "internal_type": F.lit(None).cast("string"), "confidence": F.lit(0.8),
    })


@pytest.mark.parametrize("limit", [4, 20])
def test_inference_equals_replay(spark, limit):
    rows = corpus(limit, 25, 60)
    found = relate.infer(frame(spark, rows), limit)
    gone = {(r.entity_id, r.id): r.replaced_by for r in found.superseded.collect()}
    edges = {(r.entity_id, r.rel_type, r.from_id, r.to_id) for r in found.edges.collect()}
    want_gone, want_edges = {}, set()
    for e in sorted({r[0] for r in rows}):
        mine = sorted([r[1:] for r in rows if r[0] == e], key=lambda r: (r[2], r[0]))
        g, x, d = replay(mine, limit - 1)
        want_gone |= {(e, k): v for k, v in g.items()}
        want_edges |= {(e, "UPDATES", v, k) for k, v in g.items()} | {(e, "EXTENDS", *p) for p in x} | {(e, "DERIVES_FROM", *p) for p in d}
    assert gone == want_gone
    assert edges == want_edges


def test_arrivals_continue_a_stored_table(spark):
    """Inferring in two steps equals inferring at once."""
    rows = corpus(5, 12, 40)
    whole = relate.infer(frame(spark, rows), 6)
    cut_at = DAY + dt.timedelta(hours=20)
    old, new = [r for r in rows if r[3] < cut_at], [r for r in rows if r[3] >= cut_at]
    first = relate.infer(frame(spark, old), 6)
    stored = relate.supersede(frame(spark, old), first.superseded).drop("replaced_by")
    fresh = frame(spark, new)
    second = relate.infer(stored.unionByName(fresh, allowMissingColumns=True), 6, arrivals=fresh)
    pairs = lambda df: {(r.entity_id, r.id, r.replaced_by) for r in df.collect()}
    assert pairs(first.superseded) | pairs(second.superseded) == pairs(whole.superseded)
    links = lambda df: {tuple(r)[:4] for r in df.select("entity_id", "from_id", "to_id", "rel_type").collect()}
    assert links(first.edges) | links(second.edges) == links(whole.edges)


def test_pair_classes(spark):
    cases = [
        ("小王在 Stripe 上班", "小王在 Google 上班", "UPDATES"), ("小王体重 62kg", "小王体重 66kg", "UPDATES"), ("明天的面试取消了", "明天的面试在三点", "UPDATES"), ("面试取消了", "明天去面试", "NONE"),
        ("小王不爱吃辣椒", "小王爱吃辣椒", "UPDATES"), ("小王搬到海边", "小王住在山里", "UPDATES"), ("小王用 Rust 写编译器", "小王喜欢 Rust", "EXTENDS"),
        ("小王喜欢跑步", "汇率又变了", "NONE"), ("same text", " same text ", "NONE"), ("a", "a b", "NONE"),
    ]
    df = spark.createDataFrame([(str(i), n, o) for i, (n, o, _) in enumerate(cases)], "k string, n string, o string")
    side = lambda c, p: relate.text_features(df.select("k", F.col(c).alias("content"))).select("k", *[F.col(x).alias(f"{p}_{x}") for x in relate._SIDE])
    got = {r.k: r.relation for r in relate.classify(side("n", "n").join(side("o", "o"), "k")).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [c[2] for c in cases]
    assert [relation(n, o) for n, o, _ in cases] == [c[2] for c in cases]


def _lead(rows, window, matches):
    leaders, out = [], {}
    for row in rows:
        cands = [r for r in reversed(leaders) if r[3] is None or r[3] > row[2]][:window]
        hits = [r for r in cands if matches(row, r)]
        if hits:
            out[row[0]] = hits
        else:
            leaders.append(row)
    return out


def ratio(n, o):
    return len(bigrams(n) & bigrams(o)) / len(bigrams(n)) if bigrams(n) else 0.0


def test_duplicate_skips_equal_replay(spark):
    rows = corpus(9, 15, 50)
    got = {(r.entity_id, r.id): r.kept_id for r in relate.duplicate_skips(frame(spark, rows), window=5).collect()}
    want = {}
    for e in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in rows if r[0] == e], key=lambda r: (r[2], r[0]))
        found = _lead(mine, 5, lambda n, o: n[1].strip() == o[1].strip() or ratio(n[1], o[1]) > 0.95)
        want |= {(e, k): v[0][0] for k, v in found.items()}
    assert got == want


def test_newest_alive(spark):
    rng = random.Random(3)
    alive, probes = [], []
    for e in range(8):
        n = rng.randint(1, 70)
        for s in range(1, n + 1):
            alive.append((f"e{e}", s, rng.choice([None, None, s, rng.randint(s, n + 2)])))
            probes.append((f"e{e}", s))
    k = 4
    got = {}
    for r in ordering.newest_alive(spark.createDataFrame(alive, "entity_id string, seq bigint, end bigint"), spark.createDataFrame(probes, "entity_id string, seq bigint"), k).collect():
        got.setdefault((r.entity_id, r.n_seq), set()).add(r.o_seq)
    for e, p in probes:
        want = sorted((s for x, s, end in alive if x == e and s < p and (end is None or p <= end)), reverse=True)[:k]
        assert got.get((e, p), set()) == set(want)


def test_sequence_over_one_hot_entity(spark):
    rows = [("hot" if i % 3 else f"e{i % 5}", f"m{i:05d}", DAY + dt.timedelta(seconds=i % 50), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, id string, created_at timestamp, valid_until timestamp").repartition(7)
    got = {(r.entity_id, r.id): r.seq for r in ordering.arrival_sequence(df).collect()}
    for e in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1]))
        assert [got[e, r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_index_finds_all_overlapping_pairs(spark):
    rows = corpus(21, 6, 70) + [("long", f"m{i:03d}", "".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(400 + i)) + WORDS[i % 5], DAY + dt.timedelta(hours=i), None) for i in range(30)]
    rows += [("long", f"n{i:03d}", WORDS[i % len(WORDS)], DAY + dt.timedelta(hours=i), None) for i in range(40)]
    features = relate.prepare_features(frame(spark, rows))
    names = {(r.entity_id, r.seq): r.id for r in features.select("entity_id", "seq", "id").collect()}
    asks = features.select("entity_id", "seq", (F.col("seq") + 1).alias("first"), (F.col("seq") + 25).alias("last"))
    got = {}
    for r in Overlaps(features).pairs(asks, None, 8).collect():
        assert (r.entity_id, r.n_seq, r.o_seq) not in got
        got[r.entity_id, r.n_seq, r.o_seq] = (r.shared, r.free)
    text = {(r[0], r[1]): r[2] for r in rows}
    want = {}
    for (e, a), n in names.items():
        for b in range(max(1, a - 25), a):
            new, old = text[e, n], text[e, names[e, b]]
            if overlaps(new, old):
                shared = bigrams(new) & bigrams(old)
                who = subjects(new) | subjects(old)
                want[e, a, b] = (len(shared), len([x for x in shared if not any(x in s or s in x for s in who)]))
    assert got == want


def test_blocks_find_all_overlapping_pairs(spark):
    rows = corpus(22, 4, 60) + [("long", f"m{i:03d}", "".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(400 + i)) + WORDS[i % 5], DAY + dt.timedelta(hours=i), None) for i in range(300)]
    rows += [("long", f"n{i:03d}", WORDS[i % len(WORDS)], DAY + dt.timedelta(hours=i), None) for i in range(40)]
    features = relate.prepare_features(frame(spark, rows))
    names = {(r.entity_id, r.id): r.seq for r in features.select("entity_id", "seq", "id").collect()}
    asks = features.select("entity_id", "seq", (F.col("seq") + 1).alias("first"), (F.col("seq") + 90).alias("last"))
    posts = features.filter("seq % 3 > 0").select("entity_id", "seq")
    found = [tuple(r) for r in Blocks(features, ["id"]).pairs(asks, posts, ["n_id", "o_id", "shared"]).collect()]
    want = []
    for e in {r[0] for r in rows}:
        mine = [(names[e, r[1]], r[1], r[2]) for r in rows if r[0] == e]
        want += [(e, n, o, len(bigrams(x) & bigrams(y))) for a, n, x in mine for b, o, y in mine if 0 < a - b <= 90 and a % 3 and overlaps(x, y)]
    assert sorted(found) == sorted(want)


def test_listed_pairs_leave_their_blocks_unshuffled(spark):
    """Pairs are as many as the square of an entity: nothing may deal them out again."""
    rows = corpus(34, 3, 30)
    df = frame(spark, rows).withColumns({"internal_type": F.lit("decision"), "confidence": F.lit(0.95)})
    sure = relate.infer(df, confirm_high_impact=True)
    decided = relate.resolve_conflicts(sure.pending, F.lit("keep_new"))
    assert decided[2].count() == sure.pending.count() > 0
    for listed in (sure.extends, sure.pending, *decided):
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def check_whole(spark, rows):
    found = relate.infer(frame(spark, rows))
    gone = {(r.entity_id, r.id): r.replaced_by for r in found.superseded.collect()}
    edges = {(r.entity_id, r.rel_type, r.from_id, r.to_id) for r in found.edges.collect()}
    want_gone, want_edges = {}, set()
    for e in sorted({r[0] for r in rows}):
        mine = sorted([r[1:] for r in rows if r[0] == e], key=lambda r: (r[2], r[0]))
        g, x, d = replay(mine, len(mine))
        want_gone |= {(e, k): v for k, v in g.items()}
        want_edges |= {(e, "UPDATES", v, k) for k, v in g.items()} | {(e, "EXTENDS", *p) for p in x} | {(e, "DERIVES_FROM", *p) for p in d}
    assert gone == want_gone
    assert edges == want_edges


def test_inference_without_a_window_equals_replay(spark):
    check_whole(spark, corpus(33, 20, 60))


def test_a_contradiction_a_thousand_arrivals_later(spark):
    """One entity of 1,500 memories; most of them are unrelated."""
    rng = random.Random(40)
    other = lambda: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥") for _ in range(5))
    rows = [("e", f"m{i:04d}", other(), DAY + dt.timedelta(minutes=i), None) for i in range(1500)]
    rows[3] = ("e", "m0003", "Nora weighs 62kg", rows[3][3], None)
    rows[4] = ("e", "m0004", "Nora weighs 70kg then", rows[4][3], rows[900][3])  # expires before it is met
    rows[1203] = ("e", "m1203", "Nora weighs 66kg", rows[1203][3], None)
    check_whole(spark, rows)
    gone = {r.id: r.replaced_by for r in relate.infer(frame(spark, rows)).superseded.collect()}
    assert gone["m0003"] == "m0004" or gone["m0003"] == "m1203"
    assert "m0004" not in gone or gone["m0004"] != "m1203"


def test_pending_without_a_window(spark):
    """Updates at stake retire nothing and are all listed while the old memory lives."""
    rows = corpus(35, 8, 40)
    df = frame(spark, rows).withColumns({"internal_type": F.when(F.crc32("id") % 2 == 0, "decision").otherwise(F.lit(None)), "confidence": F.lit(0.95)})
    found = relate.infer(df, confirm_high_impact=True)
    got = {(r.entity_id, r.new_id, r.old_id) for r in found.pending.collect()}
    wide = relate.infer(df, 1000, confirm_high_impact=True)
    assert got == {(r.entity_id, r.new_id, r.old_id) for r in wide.pending.collect()}
    assert {tuple(r) for r in found.superseded.collect()} == {tuple(r) for r in wide.superseded.collect()}


def test_leaders_without_a_window_equal_replay(spark):
    rows = corpus(41, 12, 60) + [("copies", f"m{i:03d}", WORDS[i % 3], DAY + dt.timedelta(hours=i), DAY + dt.timedelta(hours=i + 7) if i % 4 else None) for i in range(80)]
    skipped = {(r.entity_id, r.id): r.kept_id for r in relate.duplicate_skips(frame(spark, rows)).collect()}
    df = frame(spark, rows)
    retired = {(r.entity_id, r.id): (r.replaced_by, round(r.overlap, 9)) for r in relate.strengthen_preferences(df)[0].collect()}
    liked = {(r.entity_id, r.id) for r in df.filter("memory_type = 'preference'").collect()}
    want, kept = {}, {}
    for e in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in rows if r[0] == e], key=lambda r: (r[2], r[0]))
        want |= {(e, k): v[0][0] for k, v in _lead(mine, len(mine), lambda n, o: n[1].strip() == o[1].strip() or ratio(n[1], o[1]) > 0.95).items()}
        prefs = [r for r in mine if (e, r[0]) in liked]
        order = {r[0]: i for i, r in enumerate(prefs)}
        for k, hits in _lead(prefs, len(prefs), lambda n, o: ratio(n[1], o[1]) >= 0.3).items():
            text = next(r[1] for r in prefs if r[0] == k)
            best = max(hits, key=lambda o: (ratio(text, o[1]), order[o[0]]))
            kept[e, k] = (best[0], round(ratio(text, best[1]), 9))
    assert skipped == want
    assert retired == kept


def test_a_long_alternating_chain_settles_in_few_rounds(spark, monkeypatch):
    """Each row matches only the one before it: every second row leads."""
    n = 10_000
    nodes = spark.range(1, n + 1).select(F.lit("e").alias("entity_id"), F.col("id").alias("seq"))
    edges = nodes.filter("seq > 1").select("entity_id", F.col("seq").alias("n_seq"), (F.col("seq") - 1).alias("o_seq"))
    calls = []
    monkeypatch.setattr(relate, "cut", lambda df, real=relate.cut: calls.append(1) or real(df))
    leading = {r.seq for r in relate._leaders(nodes, edges).select("seq").collect()}
    assert leading == set(range(1, n + 1, 2))
    assert len(calls) < 30


def test_leaders_of_a_random_graph(spark):
    rng = random.Random(44)
    edges = {(n, o) for n in range(2, 120) for o in rng.sample(range(1, n), min(n - 1, rng.choice([0, 1, 1, 2, 3])))}
    lead = set()
    for n in range(1, 120):
        if not any((n, o) in edges for o in lead):
            lead.add(n)
    nodes = spark.createDataFrame([("e", n) for n in range(1, 120)], "entity_id string, seq bigint")
    pairs = spark.createDataFrame([("e", *p) for p in edges], "entity_id string, n_seq bigint, o_seq bigint")
    assert {r.seq for r in relate._leaders(nodes, pairs).collect()} == lead


def test_containment_equals_all_pairs(spark):
    rng = random.Random(46)
    texts = [rng.choice(WORDS) + rng.choice(["", " 了", "好", "x"]) for _ in range(60)] + ["".join(rng.choice("abcdefghij") for _ in range(k)) for k in (2, 3, 4, 200, 300, 400, 401)]
    texts += [texts[-1][:380] + "zz", texts[-1][100:]]
    df = spark.createDataFrame([("e", t) for t in sorted(set(texts))], "entity_id string, content string")
    features = relate.text_features(df).withColumn("key", F.col("content"))
    for share in (0.3, 0.95):
        got = {(r.n_key, r.o_key): round(r.ratio, 9) for r in contained_pairs(features, share).collect()}
        want = {(n, o): round(ratio(n, o), 9) for n in set(texts) for o in set(texts) if n != o and ratio(n, o) >= share}
        assert got == want


def test_compressed_tables_are_not_broadcast_unmeasured(spark):
    """A million rows may be a few hundred kilobytes of files; joins must not take them for a small table."""
    n = F.col("id")
    rows = cut(prepare(spark).range(1_000_000).select(F.lit("source").alias("entity_id"), F.floor(n / 97).alias("seq"), (n % 97).alias("code"), (n % 3 == 0).alias("heavy")))
    plan = rows.join(rows.withColumnRenamed("heavy", "other"), ["entity_id", "seq", "code"])._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    tiny = cut(spark.range(20).select(n.alias("code"), F.lit("x").alias("name")))
    assert "BroadcastHashJoin" in rows.join(tiny, "code")._jdf.queryExecution().sparkPlan().toString()


def test_memories_without_a_common_rule_never_meet(spark, monkeypatch):
    """Finished things retire planned ones only, so hundreds of finished ones are not compared with each other."""
    texts = ["明天有考试1"] * 3 + [f"考试{n % 7}结束" for n in range(300)] + ["考试预算是 12 万", "考试预算是 14 万"]
    rows = [("e", f"m{n:04d}", t, DAY + dt.timedelta(minutes=n), None, True, "fact", None, 0.5) for n, t in enumerate(texts)]
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, created_at timestamp, valid_until timestamp, is_latest boolean, memory_type string, internal_type string, confidence double")
    met, judge = [], relate.judge
    monkeypatch.setattr(relate, "judge", lambda pairs, *rest: met.append(pairs.count()) or judge(pairs, *rest))
    found = {(r.id, r.replaced_by) for r in relate.infer(memories).superseded.collect()}
    assert found == {("m0000", "m0004"), ("m0001", "m0004"), ("m0002", "m0004"), ("m0303", "m0304")}
    assert sum(met) < 1000


def test_texts_that_are_not_contained_stay_in_their_blocks(spark):
    """Long texts overlap nearly all; only contained pairs may leave the comparison, and a block is sent to few others."""
    rng = random.Random(47)
    texts = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(150)) for _ in range(1500)]
    texts += [t + "zz" for t in texts[::100]]
    features = relate.text_features(spark.createDataFrame([("e", t) for t in texts], "entity_id string, content string")).withColumn("key", F.col("content"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    got = {(r.n_key, r.o_key) for r in contained_pairs(features, 0.95).collect()}
    assert got >= {(t, t + "zz") for t in texts[:1500:100]}
    assert written() - before < 25_000_000


@pytest.mark.parametrize("seconds", [None, 900])
def test_texts_that_all_match_are_listed_with_leaders_only(spark, monkeypatch, seconds):
    """Preferences that nearly all match each other follow a few of them; no table of all pairs is written."""
    rng, sizes, plain = random.Random(53), [], relate.cut
    texts = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(60, 140))) for _ in range(1500)]
    ends = [DAY + dt.timedelta(seconds=seconds) if seconds and n < 40 else None for n in range(len(texts))]
    rows = [("e", f"m{n:04d}", t, DAY + dt.timedelta(seconds=n), ends[n], True, "preference", None, 0.5) for n, t in enumerate(texts)]

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(relate, "cut", counted)
    memories = spark.createDataFrame(rows, "entity_id string, id string, content string, created_at timestamp, valid_until timestamp, is_latest boolean, memory_type string, internal_type string, confidence double")
    got = {r.id: (r.replaced_by, round(r.overlap, 9)) for r in relate.strengthen_preferences(memories)[0].collect()}
    grams, leaders, want = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts], [], {}
    for n in range(len(texts)):
        hits = [(len(grams[n] & grams[o]) / len(grams[n]), o) for o in leaders if ends[o] is None or n < seconds]
        hits = [h for h in hits if h[0] >= 0.3]
        if hits:
            want[f"m{n:04d}"] = (f"m{max(hits)[1]:04d}", round(max(hits)[0], 9))
        else:
            leaders.append(n)
    assert got == want and len(leaders) < 100
    assert max(sizes) < 600_000
