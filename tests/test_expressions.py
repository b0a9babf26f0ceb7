"""Scalar rules, filters and text splitters on small hand-made inputs."""

import datetime as dt

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.functions.filters import compile_filter, effective_filter
from factloom.operators import corpus
from factloom.sources import tables

NOW = "2024-02-01 00:00:00"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_deadlines(spark):
    cases = [
        ("到 2026-08-15 前交", "2026-08-15"), ("in 2026/9 we ship", "2026-09-30"), ("2026-09-31 is no day", "2026-09-30"), ("back in 2020-01-05", None),
        ("今天或后天", "2026-08-05"), ("大后天出发", "2026-08-06"), ("明日见", "2026-08-04"), ("10天后", "2026-08-13"), ("0天后", None), ("see you tomorrow", "2026-08-04"),
        ("Tomorrow", None), ("2 days later", "2026-08-05"), ("下周开会", "2026-08-16"), ("next month", "2026-09-30"), ("6个月后", "2027-02-03"), ("明年", "2027-12-31"), ("nothing", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    ref = F.lit("2026-08-03 10:00:00").cast("timestamp")
    got = {r.i: r.x for r in df.select("i", F.date_format(X.deadline(F.col("t"), ref), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [w and f"{w} 23:59:59" for _, w in cases]
    end = X.deadline(F.lit("1 months later"), F.lit("2026-01-31 08:00:00").cast("timestamp"))
    assert df.limit(1).select(end.alias("x")).first().x == dt.datetime(2026, 2, 28, 23, 59, 59)


def test_trust(spark):
    base = dict(confidence=0.8, provenance="explicit_statement", validation_count=0, contradiction_detected=False, is_latest=True, memory_type="fact", age=0)
    cases = [
        ({}, 0.8), ({"provenance": "inferred"}, 0.56), ({"provenance": "rumour"}, 0.8), ({"validation_count": 3}, 0.89), ({"validation_count": 9}, 0.95), ({"is_latest": False}, 0.0),
        ({"contradiction_detected": True}, 0.24), ({"contradiction_detected": True, "confidence": 0.1}, 0.1), ({"memory_type": "episodic", "age": 31}, 0.7),
        ({"memory_type": "episodic", "age": 30}, 0.8), ({"memory_type": "preference", "age": 91}, 0.6), ({"age": 91}, 0.8), ({"confidence": 1.0, "validation_count": 5}, 1.0), ({"confidence": None}, 0.8),
    ]
    rows = []
    for i, (change, _) in enumerate(cases):
        c = base | change
        rows.append((i, c["confidence"], c["provenance"], c["validation_count"], c["contradiction_detected"], c["is_latest"], c["memory_type"], dt.datetime(2024, 2, 1) - dt.timedelta(days=c["age"])))
    df = spark.createDataFrame(rows, "i int, confidence double, provenance string, validation_count int, contradiction_detected boolean, is_latest boolean, memory_type string, created_at timestamp")
    got = {r.i: r.x for r in df.select("i", X.trust(NOW).alias("x")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == pytest.approx(want), cases[i]


def test_conflict_impact(spark):
    df = spark.createDataFrame([("decision", "fact", 0.95, "goal", "fact"), ("error", "fact", 0.95, None, "episodic"), (None, "noise", 0.5, "goal", "noise")], "n_internal_type string, n_memory_type string, n_confidence double, o_internal_type string, o_memory_type string")
    got = [(round(r.i, 4), r.c) for r in df.select(X.impact().alias("i"), X.requires_confirmation().alias("c")).collect()]
    assert got == [(1.0, True), (0.54, False), (0.4, False)]


def test_filters(spark):
    df = spark.createDataFrame([("a", "fact", 0.9, "work"), ("b", "fact", None, None), ("c", "noise", 0.2, "home")], "id string, memory_type string, confidence double, container_tag string")
    run = lambda spec: [r.id for r in df.filter(compile_filter(spec, df.columns)).orderBy("id").collect()]
    assert run(None) == ["a", "b", "c"]
    assert run({"memory_type": "fact", "confidence": {"$gte": 0.5}}) == ["a"]
    assert run({"confidence": {"$ne": 0.9}}) == ["c"]
    assert run({"container_tag": None}) == ["b"]
    assert run({"$or": [{"id": "a"}, {"container_tag": "home"}]}) == ["a", "c"]
    assert run({"$and": [{"memory_type": "fact"}], "id": "zzz"}) == ["a", "b"]
    assert run({"no_such_key": "x"}) == [] and run({"no_such_key": {"$gt": 1}}) == []
    assert run(effective_filter({"memory_type": "fact"}, "work")) == ["a"]
    with pytest.raises(ValueError):
        effective_filter({"container_tag": "x"}, "work")


def test_text_chunks(spark):
    assert one(spark, "", corpus.text_chunks) == []
    assert one(spark, "short one\n\n\n\nshort two", corpus.text_chunks) == ["short one\n\nshort two"]
    sentence = "word " * 60 + "end."
    chunks = one(spark, " ".join([sentence] * 20), corpus.text_chunks)
    assert len(chunks) == 4 and all(len(c) <= 2049 for c in chunks)
    assert " ".join(chunks) == " ".join([sentence] * 20)


def test_markdown_and_code(spark):
    text = "pre\n# A\nbody\n## B\nx\n```\n# not\n```\n# C\ny"
    got = [("/".join(r.path), r.text, r.is_code) for r in one(spark, text, corpus.markdown_sections)]
    assert got == [("", "pre", False), ("A", "# A\nbody", False), ("A/B", "## B\nx", False), ("", "```\n# not\n```", True), ("C", "# C\ny", False)]
    blocks = one(spark, "def go(x):\n  pass\n\n\nx = 1", corpus.code_blocks)
    assert [(b.text, b.name, b.lines) for b in blocks] == [("def go(x):\n  pass", "go", 2), ("x = 1", "module", 1)]
    assert one(spark, "fn main() {}", corpus.code_language) == "rust"


def test_structured_payloads(spark):
    assert one(spark, '{"a": 1}', tables.content_type_of) == "json"
    assert one(spark, "[1, 2", tables.content_type_of) == "text"
    assert one(spark, "12", tables.content_type_of) == "text"
    assert one(spark, "a;b\n1;2", tables.content_type_of) == "csv"
    assert one(spark, "Hello, you.\nBye.", tables.content_type_of) == "text"
    assert one(spark, '[{"a": "x, y: z"}, 1, "s", null]', corpus.json_batches) == ['[{"a": "x, y: z"}, 1, "s", null]']
    assert one(spark, '{"b": [1, 2], "a": "t"}', corpus.json_batches) == ['{"b": [1, 2]}', '{"a": "t"}']
    assert one(spark, "h1,h2\n1,2\n3,4", lambda c: corpus.csv_batches(c, 10)) == ["h1,h2\n1,2", "h1,h2\n3,4"]
    assert one(spark, "h1,h2", corpus.csv_batches) == ["h1,h2"]
    assert one(spark, 'h1,h2\n"a, b",c', corpus.csv_batches) == ['h1,h2\n"a, b",c']


def test_long_strings_inside_records(spark):
    long = 'x, \\"y: ' * 20_000
    assert one(spark, '[{"a":"%s","b":1}]' % long, corpus.json_batches) == ['[{"a": "%s", "b": 1}]' % long]
    row = '"' + "a, b\n" * 20_000 + '",c'
    assert one(spark, "h1,h2\n" + row, lambda c: F.get(corpus.csv_batches(c), F.lit(0)).startswith("h1,h2\n")) is True


def test_splitters_read_a_text_once(spark):
    """The language is not found anew for each block, and packing folds lengths instead of texts."""
    plan = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan("t7_t12_code_blocks").split("Generate explode")[0]
    assert "substring_index" not in above and "regexp_replace" not in above
    for name in ("t4_csv_batches", "t5_json_batches", "t6_paragraph_chunks"):
        assert "[[],null]" not in plan(name)


def test_transcript_and_masking(spark):
    turns = one(spark, "User: hi there\n**Assistant**: yes\nmore\nBOT : ok", corpus.transcript_turns)
    assert [(t.speaker, t.text) for t in turns] == [("User", "hi there"), ("Assistant", "yes\nmore"), ("BOT", "ok")]
    masked = one(spark, "mail a.b@c.org, ip 10.0.0.1, ssn 123-45-6789, Bearer abc.def", X.mask_pii)
    assert masked == "mail [EMAIL], ip [IP], ssn [SSN], [TOKEN]"
    df = spark.createDataFrame([("k", "a@b.co", 1)], "user_token string, note string, n int")
    assert tuple(corpus.redact_columns(df).first()) == ("[REDACTED]", "[EMAIL]", 1)


def test_fast_lane_cuts(spark):
    text = "a" * 700 + ". " + "b" * 900 + "\n\nshort"
    pieces = one(spark, text, corpus.fast_lane_pieces)
    assert pieces == ["a" * 700, ". " + "b" * 900, "short"]


def test_source_sync(spark):
    items = spark.createDataFrame([("a", "1", "v1", "x"), ("a", "2", "v2", "y"), ("a", "2", "v2", "y"), ("a", None, None, "z"), ("a", "3", None, "")], "account_id string, id string, etag string, content string")
    seen = spark.createDataFrame([("a", "1", "v1"), ("a", "2", "v1")], "account_id string, source_id string, etag string")
    out = tables.sync_items(tables.normalise_items(items), seen)
    r = tables.sync_report(out).first()
    assert (r.ingested, r.skipped, r.failed, r.errors) == (1, 3, 1, "3: empty content")
    assert {tuple(x) for x in tables.updated_seen(seen, out).select("account_id", "source_id", "etag").collect()} == {("a", "1", "v1"), ("a", "2", "v2")}


def test_versions_that_come_back_are_ingested_again(spark):
    rows = [("a", "x", "v1", "one", 1), ("a", "x", "v2", "two", 2), ("a", "x", "v1", "one again", 3), ("a", "x", "v1", "copy", 4), ("a", "x", "v3", "", 5), ("a", "x", "v1", "still", 6), ("b", "y", "9", "old", 1), ("b", "y", "10", "new", 2)]
    raw = spark.createDataFrame(rows, "account_id string, id string, etag string, body string, position bigint")
    seen = spark.createDataFrame([("a", "x", "v0"), ("a", "z", "k")], "account_id string, source_id string, etag string")
    out = tables.sync_items(tables.normalise_items(raw), seen)
    got = {(r.account_id, r.position): (r.outcome, r.content) for r in out.collect()}
    assert [got["a", i][0] for i in range(1, 7)] == ["ingested", "ingested", "ingested", "skipped", "failed", "skipped"]
    assert {tuple(r) for r in tables.updated_seen(seen, out).collect()} == {("a", "x", "v1"), ("a", "z", "k"), ("b", "y", "10")}


def test_account_events_set_bindings(spark):
    events = spark.createDataFrame([("a", "account.connected", 1), ("a", "connection.deleted", 2), ("b", "account.revoked", 1), ("b", "connection.updated", 3), ("b", "error", 4), ("c", "account.connected", 1)], "account_id string, event_type string, position bigint")
    bindings = spark.createDataFrame([("a",), ("b",)], "account_id string")
    assert {tuple(r) for r in tables.binding_states(events, bindings).collect()} == {("a", "revoked"), ("b", "active")}
    known, unknown = tables.event_items(events, bindings)
    assert {(r.account_id, r.position) for r in known.collect()} == {("a", 1), ("b", 3), ("b", 4)}
    assert {(r.account_id, r.position) for r in unknown.collect()} == {("c", 1)}
