"""Queries over mentions, vectors, retrieval and graph walks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import graph, mentions, search, vectors
from factloom.operators.scans import latest_memories, newest
from factloom.plans.catalog_tables import SQL_TRUST, WITH_MEM, r6, stamp
from factloom.plans.registry import query
from factloom.session import cut
from factloom.sources import seed
from factloom.sources.seed import NOW, SQL_EDGE, SQL_EMB, SQL_FAST, SQL_GAZ, SQL_QUERY

TS = "'%Y-%m-%d %H:%M:%S'"
NINE = "floor(({}) * 1000000000.0::double + 0.5) / 1000000000.0::double"

# ---------------------------------------------------------------- seeds


class Tables:
    """Derived tables of one data folder, each built when first asked for.

    Mention edges stand for a stored table, so they are written once.
    """

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.docs = seed.read(spark, d, "documents")

    @cached_property
    def memories(self):
        return seed.memories(self.docs)

    @cached_property
    def edges(self):
        return seed.edges(self.docs)

    @cached_property
    def embeddings(self):
        return seed.embeddings(self.docs)

    @cached_property
    def fast_lane(self):
        return seed.fast_lane(seed.read(self.spark, self.d, "conversations"))

    @cached_property
    def queries(self):
        q = search.clamp_top_k(seed.queries(seed.read(self.spark, self.d, "benchmark")))
        return q.withColumn("embedding", X.hash_embedding(F.col("q"), seed.DIMS))

    @cached_property
    def found(self):
        texts = self.memories.select("entity_id", F.col("id").alias("memory_id"), "content", "created_at")
        return mentions.extract_mentions(texts, seed.gazetteer(self.spark))

    @cached_property
    def mention_edges(self):
        return cut(mentions.attach_mentions(self.found))

    @cached_property
    def asks(self):
        forms = sorted({c for _, c, _ in seed.GAZETTEER})
        rows = self.docs.select(F.col("source").alias("entity_id")).distinct().select("entity_id", F.explode(F.array(*[F.lit(f) for f in forms])).alias("about"))
        return search.clamp_top_k(rows.select(F.concat_ws(":", "entity_id", "about").alias("query_id"), "entity_id", "about", F.lit(None).cast("int").alias("top_k")))


SQL_FOUND = f"""gaz AS ({SQL_GAZ}), found AS (SELECT m.entity_id, m.id AS memory_id, m.created_at, g.ord, g.canonical AS canonical_form, g.type,
  length(regexp_extract(m.content, '(?is)^((?:.*?[^a-z0-9])??)' || g.key || '(?:[^a-z0-9]|$)', 1)) + 1 AS position,
  regexp_extract(m.content, '(?is)^(?:.*?[^a-z0-9])??(' || g.key || ')(?:[^a-z0-9]|$)', 1) AS surface_form
  FROM mem m JOIN gaz g ON regexp_matches(m.content, '(?i)(^|[^a-z0-9])' || g.key || '([^a-z0-9]|$)')),
 me AS (SELECT entity_id, memory_id, sha256(entity_id || chr(31) || canonical_form || chr(31) || type) AS mention_id, canonical_form, type, surface_form, min(created_at) AS created_at FROM found GROUP BY ALL)"""
SQL_BASE = WITH_MEM + f", e AS ({SQL_EMB}), q AS (SELECT *, {seed.sql_hash_embedding('q')} AS embedding FROM ({SQL_QUERY})), ed AS ({SQL_EDGE}), fl AS ({SQL_FAST}), tr AS (SELECT *, {SQL_TRUST} AS trust FROM mem)"


def sql_near(name: str, source: str, where: str, most: str, key: str = "chunk_id") -> str:
    score = NINE.format(seed.sql_cosine("q.embedding", "v.embedding"))
    return f"""{name} AS (SELECT * FROM (SELECT q.query_id, q.entity_id, q.k, v.{key} AS id, v.text AS content, {score} AS score FROM q JOIN {source} v USING (entity_id) WHERE {where})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {most})"""


LIVE = "is_latest AND (valid_until IS NULL OR valid_until >= timestamp '2024-02-01')"
SQL_R1 = sql_near("near", "e", "v.document_id IS NULL", "least(k * 5, 200)") + f""",
 r1 AS (SELECT n.query_id, n.entity_id, n.id, t.content, n.score * t.trust AS score, 'memory' AS source, 0 AS depth, true AS is_latest FROM near n JOIN tr t ON t.id = n.id AND t.entity_id = n.entity_id WHERE {LIVE}
  QUALIFY row_number() OVER (PARTITION BY n.query_id ORDER BY n.score * t.trust DESC, n.id) <= any_value(n.k) OVER (PARTITION BY n.query_id))"""
SQL_R4 = sql_near("near4", "e", "v.document_id IS NOT NULL", "k") + ", r4 AS (SELECT query_id, entity_id, id, content, score, 'rag' AS source, 0 AS depth, true AS is_latest FROM near4 WHERE score >= 0)"
SQL_R5 = sql_near("near5", "fl", "v.stage = 'fast_lane' AND v.created_at >= timestamp '2024-01-31'", "k", "id") + ", r5 AS (SELECT query_id, entity_id, id, content, score * 0.9::double AS score, 'fast_lane' AS source, 0 AS depth, true AS is_latest FROM near5)"
SQL_NB = """nb AS (SELECT x.*, m.is_latest AS other_latest FROM (SELECT entity_id, from_id AS id, rel_type, to_id AS other, created_at FROM ed UNION ALL
  SELECT entity_id, to_id, rel_type, from_id, created_at FROM ed) x JOIN mem m ON m.id = x.other AND m.entity_id = x.entity_id)"""


def sql_expand(name: str, base: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT * FROM {base} UNION ALL
  SELECT f.query_id, f.entity_id, f.other, t.content, f.score * 0.85::double * t.trust, 'memory_expanded', 1, true FROM (
   SELECT r.query_id, r.entity_id, n.other, r.score FROM {base} r JOIN nb n ON n.id = r.id AND n.entity_id = r.entity_id
   WHERE n.other_latest AND n.rel_type IN ('EXTENDS', 'DERIVES_FROM') AND NOT EXISTS (SELECT 1 FROM {base} s WHERE s.query_id = r.query_id AND s.id = n.other)
   QUALIFY row_number() OVER (PARTITION BY r.query_id, n.other ORDER BY r.score DESC, r.id, n.created_at, n.rel_type) = 1) f JOIN tr t ON t.id = f.other)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, depth, id) <= 2 * (SELECT any_value(k) FROM q WHERE q.query_id = u.query_id)) """.replace("FROM (SELECT * FROM " + base, "FROM (SELECT * FROM " + base).replace("t.id = f.other)\n", "t.id = f.other) u\n")


def sql_merge(union: str, truncate: bool = True, table: str = "q") -> str:
    """Sequential merge written as windows over one union."""
    order = "score DESC, depth, id, source"
    stop = "coalesce(rank > least(k, CASE WHEN k <= 5 THEN 3 ELSE 2 END) AND prev - score > 0.15 AND is_latest, false)" if truncate else "false"
    return f"""m1 AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY {order}) = 1),
 m2 AS (SELECT * FROM m1 QUALIFY source = first_value(source) OVER (PARTITION BY query_id, lower(trim(content)) ORDER BY {order})),
 m3 AS (SELECT m2.*, q.k, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank, lag(score) OVER (PARTITION BY query_id ORDER BY {order}) AS prev FROM m2 JOIN {table} q USING (query_id)),
 m4 AS (SELECT *, max(CASE WHEN {stop} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS stopped FROM m3)
SELECT query_id, id, source, depth, {r6('score')} AS score, rank::int AS rank FROM m4 WHERE stopped = 0 AND rank <= k"""


def _out(df):
    return df.select("query_id", "id", X.fixed(F.col("score"), 6).alias("score"))


# ---------------------------------------------------------------- mentions


@query("t11_gazetteer_mentions", WITH_MEM + f", {SQL_FOUND} SELECT memory_id, surface_form, canonical_form, type, row_number() OVER (PARTITION BY memory_id ORDER BY position, ord)::int AS place FROM found")
def t11(spark, d):
    """First hit of each gazetteer key per text, in order."""
    found = Tables(spark, d).found
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy("position", "ord"))
    return found.select("memory_id", "surface_form", "canonical_form", "type", place.alias("place"))


@query("g9_mention_edges", WITH_MEM + f", {SQL_FOUND} SELECT entity_id, memory_id, mention_id, surface_form, strftime(created_at, {TS}) AS created_at FROM me")
def g9(spark, d):
    """MENTIONS edges after type, confidence and surface rules."""
    return Tables(spark, d).mention_edges.select("entity_id", "memory_id", "mention_id", "surface_form", stamp("created_at"))


@query("a3_mention_nodes", WITH_MEM + f""", {SQL_FOUND}, s AS (SELECT entity_id, mention_id, canonical_form, type, surface_form, count(*) AS n, min(created_at) AS f, max(created_at) AS l FROM me GROUP BY ALL)
SELECT entity_id, mention_id, canonical_form, type, string_agg(surface_form, '|' ORDER BY f, surface_form) AS aliases, sum(n)::bigint AS mention_count, strftime(min(f), {TS}) AS created_at, strftime(max(l), {TS}) AS last_seen_at FROM s GROUP BY ALL""")
def a3(spark, d):
    """A3: mention nodes."""
    nodes = mentions.mention_nodes(Tables(spark, d).mention_edges)
    return nodes.withColumn("aliases", F.array_join("aliases", "|")).withColumn("created_at", stamp("created_at")).withColumn("last_seen_at", stamp("last_seen_at"))


@query("a4_mention_recount", WITH_MEM + f", {SQL_FOUND} SELECT me.entity_id, mention_id, canonical_form, count(*) AS mention_count FROM me JOIN mem ON mem.id = me.memory_id WHERE mem.confidence >= 0.95 GROUP BY ALL")
def a4(spark, d):
    """A4: recount after weak memories lost their edges; unused nodes go."""
    t = Tables(spark, d)
    nodes = mentions.mention_nodes(t.mention_edges)
    strong = t.memories.filter("confidence >= 0.95").select("entity_id", F.col("id").alias("memory_id"))
    left = t.mention_edges.join(strong, ["entity_id", "memory_id"], "left_semi")
    return mentions.recount_mentions(nodes, left).select("entity_id", "mention_id", "canonical_form", "mention_count")


@query("g10_mention_reads", WITH_MEM + f", {SQL_FOUND} SELECT me.entity_id, memory_id, mention_id, surface_form, canonical_form, me.type FROM me JOIN mem ON mem.id = memory_id WHERE memory_type = 'preference'")
def g10(spark, d):
    """Mentions of asked memories."""
    t = Tables(spark, d)
    asked = t.memories.filter("memory_type = 'preference'").select("entity_id", F.col("id").alias("memory_id"))
    return mentions.mentions_of_memories(t.mention_edges, mentions.mention_nodes(t.mention_edges), asked)


SQL_ASKS = "asks AS (SELECT DISTINCT source || ':' || canonical AS query_id, source AS entity_id, canonical AS about, 30 AS k FROM documents, gaz)"
SQL_R3 = f"""r3 AS (SELECT h.query_id, h.entity_id, t.id, t.content, t.trust AS score, 'memory' AS source, 0 AS depth, true AS is_latest, t.created_at FROM (SELECT * FROM (SELECT DISTINCT a.query_id, a.entity_id, me.memory_id FROM asks a JOIN me ON me.entity_id = a.entity_id AND me.canonical_form = a.about) z
   JOIN mem ON mem.id = z.memory_id WHERE is_latest) h JOIN tr t ON t.id = h.memory_id WHERE t.valid_until IS NULL OR t.valid_until >= timestamp '2024-02-01'
  QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY t.trust DESC, t.created_at DESC, t.id) <= 30)"""


@query("r3_about_search", SQL_BASE + f", {SQL_FOUND}, {SQL_ASKS}, {SQL_R3} SELECT query_id, id, {r6('score')} AS score FROM r3")
def r3(spark, d):
    """Memories that mention a thing."""
    t = Tables(spark, d)
    return _out(search.about_search(t.asks, t.memories, t.mention_edges, NOW))


# ---------------------------------------------------------------- vectors


@query("l1_vector_top_k", f"""WITH e AS (SELECT label::varchar AS entity_id, vec_id, embedding FROM embeddings), s AS (SELECT q.vec_id AS q_id, e.vec_id, {NINE.format("coalesce(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 0.0)")} AS score
 FROM e q JOIN e USING (entity_id))
SELECT 'v' || q_id::varchar AS query_id, 'v' || vec_id::varchar AS chunk_id, {r6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, 'v' || vec_id::varchar) <= 10""")
def l1(spark, d):
    """L1: ten nearest vectors of the same label for every vector."""
    e = seed.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("entity_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    q = e.select(F.col("chunk_id").alias("query_id"), "entity_id", "embedding")
    return vectors.vector_top_k(q, e, 10).select("query_id", "chunk_id", X.fixed(F.col("score"), 6).alias("score"))


@query("r1_vector_search", SQL_BASE + f", {SQL_R1} SELECT query_id, id, {r6('score')} AS score FROM r1")
def r1(spark, d):
    """Vector search with trust for a table of queries."""
    t = Tables(spark, d)
    return _out(search.vector_search(t.queries, t.memories, t.embeddings, NOW))


@query("r2_keyword_search", SQL_BASE + f""", qt AS (SELECT query_id, entity_id, k, list_concat(regexp_extract_all(lower(q), '[a-zA-Z0-9]+'), regexp_extract_all(q, '[\\x{{4e00}}-\\x{{9fff}}]')) AS terms FROM q),
 s AS (SELECT query_id, k, t.id, len(list_filter(terms, lambda x: contains(lower(t.content), x)))::double / len(terms) AS m, trust FROM qt JOIN tr t USING (entity_id) WHERE {LIVE} AND len(terms) > 0)
SELECT query_id, id, {r6('m * trust')} AS score FROM s WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m * trust DESC, id) <= any_value(k) OVER (PARTITION BY query_id)""")
def r2(spark, d):
    """Keyword search."""
    t = Tables(spark, d)
    return _out(search.keyword_search(t.queries, t.memories, NOW))


SQL_TRI = "list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower({}), '[\\pL\\pN]+')), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("r2_fuzzy_search", SQL_BASE + f""", qt AS (SELECT query_id, entity_id, k, {SQL_TRI.format('q')} AS g, list_concat(regexp_extract_all(lower(q), '[a-zA-Z0-9]+'), regexp_extract_all(q, '[\\x{{4e00}}-\\x{{9fff}}]')) AS terms FROM q),
 mt AS (SELECT *, {SQL_TRI.format('content')} AS g FROM tr WHERE {LIVE}),
 s AS (SELECT query_id, k, t.id, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(lower(t.content), x)))::double / len(terms) ELSE 0 END AS kw,
  len(list_intersect(qt.g, t.g))::double / (len(qt.g) + len(t.g) - len(list_intersect(qt.g, t.g))) AS sim, trust FROM qt JOIN mt t USING (entity_id)),
 z AS (SELECT query_id, k, id, greatest(kw, CASE WHEN sim >= 0.2 THEN sim ELSE 0 END) * trust AS score, greatest(kw, CASE WHEN sim >= 0.2 THEN sim ELSE 0 END) AS m FROM s)
SELECT query_id, id, {r6('score')} AS score FROM z WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= any_value(k) OVER (PARTITION BY query_id)""")
def r2f(spark, d):
    """Keyword search with the trigram half."""
    t = Tables(spark, d)
    return _out(search.keyword_search(t.queries, t.memories, NOW, similarity=0.2))


@query("r4_document_search", SQL_BASE + f", {SQL_R4} SELECT query_id, id, {r6('score')} AS score FROM r4")
def r4(spark, d):
    """Document chunk search."""
    t = Tables(spark, d)
    return _out(search.document_search(t.queries, t.embeddings))


@query("r5_fast_lane_search", SQL_BASE + f", {SQL_R5} SELECT query_id, id, {r6('score')} AS score FROM r5")
def r5(spark, d):
    """Fast-lane search."""
    t = Tables(spark, d)
    return _out(search.fast_lane_search(t.queries, t.fast_lane, NOW))


@query("g13_l6_relation_expansion", SQL_BASE + f", {SQL_R1}, {SQL_NB}, {sql_expand('r13', 'r1')} SELECT query_id, id, source, {r6('score')} AS score FROM r13")
def g13(spark, d):
    """One-hop expansion of vector results."""
    t = Tables(spark, d)
    base = cut(search.vector_search(t.queries, t.memories, t.embeddings, NOW))
    return search.expand_relations(base, t.memories, t.edges, t.queries, NOW).select("query_id", "id", "source", X.fixed(F.col("score"), 6).alias("score"))


@query("u1_w3_w4_merge", SQL_BASE + f", {SQL_R1}, {SQL_R4}, {SQL_R5}, " + sql_merge("SELECT * FROM r1 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5"))
def u1(spark, d):
    """Merge of three sources with de-duplication and gap cut."""
    t = Tables(spark, d)
    parts = search.vector_search(t.queries, t.memories, t.embeddings, NOW).unionByName(search.document_search(t.queries, t.embeddings)).unionByName(search.fast_lane_search(t.queries, t.fast_lane, NOW))
    return search.merge_results(parts, t.queries).select("query_id", "id", "source", "depth", X.fixed(F.col("score"), 6).alias("score"), "rank")


def _hybrid(spark, d, **kw):
    t = Tables(spark, d)
    asked = t.asks if kw.get("about") else t.queries
    out = search.hybrid_search(asked, t.memories, t.embeddings, t.edges, t.mention_edges, t.fast_lane, NOW, **kw)
    return out.select("query_id", "id", "source", "depth", X.fixed(F.col("score"), 6).alias("score"), "rank")


SQL_HYBRID = SQL_BASE + f", {SQL_R1}, {SQL_R4}, {SQL_R5}, {SQL_NB}, {sql_expand('r13', 'r1')}, " + sql_merge("SELECT * FROM r13 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5")


@query("r6_hybrid_search", SQL_HYBRID)
def r6h(spark, d):
    """Hybrid search without graph walk."""
    return _hybrid(spark, d)


@query("r6_rag_search", SQL_BASE + f", {SQL_R4}, " + sql_merge("SELECT * FROM r4"))
def r6r(spark, d):
    """Mode rag."""
    return _hybrid(spark, d, mode="rag")


@query("r6_about_search", SQL_BASE + f", {SQL_FOUND}, {SQL_ASKS}, {SQL_R3}, " + sql_merge("SELECT * EXCLUDE (created_at) FROM r3", False, "asks"))
def r6a(spark, d):
    """Entity-centric mode."""
    return _hybrid(spark, d, about=True)


def sql_walk(base: str, order: str) -> str:
    """Two explicit levels of the walk from the results in ``base``."""
    def level(n: int, visited: str) -> str:
        f = f"w{n - 1}"
        return f"""d{n} AS (SELECT query_id, entity_id, mention_id, min({{'key': list_concat(key, ['0', lpad(epoch_us(linked_at)::varchar, 20, '0'), mention_id]), 'path': path || ' > mention:' || mention_id}}) AS f
  FROM {f} JOIN links USING (entity_id, id) WHERE NOT historical GROUP BY ALL),
 c{n} AS (SELECT d.query_id, d.entity_id, s.other AS id, list_concat(d.f.key, [lpad((9000000000000000 - epoch_us(s.created_at))::varchar, 20, '0'), s.other]) AS key, d.f.path || ' > memory:' || s.other AS path, false AS historical
   FROM d{n} d JOIN sib s USING (entity_id, mention_id)
  UNION ALL SELECT w.query_id, w.entity_id, n.other, list_concat(w.key, ['1', lpad(epoch_us(n.created_at)::varchar, 20, '0'), n.rel_type, n.other]), w.path || ' > ' || n.rel_type || ':' || n.other, NOT n.other_latest
   FROM {f} w JOIN nb n ON n.entity_id = w.entity_id AND n.id = w.id WHERE NOT w.historical AND (n.other_latest OR n.rel_type = 'UPDATES')),
 w{n} AS (SELECT query_id, entity_id, id, f.key AS key, f.path AS path, f.historical AS historical, {n} AS depth FROM (
   SELECT query_id, entity_id, id, min({{'key': key, 'path': path, 'historical': historical}}) AS f FROM c{n} c WHERE NOT EXISTS (SELECT 1 FROM ({visited}) v WHERE v.query_id = c.query_id AND v.id = c.id) GROUP BY ALL))"""

    return f"""links AS (SELECT entity_id, memory_id AS id, mention_id, min(created_at) AS linked_at FROM me GROUP BY ALL),
 sib AS (SELECT l.entity_id, l.mention_id, m.id AS other, m.created_at FROM links l JOIN mem m ON m.id = l.id WHERE m.is_latest),
 w0 AS (SELECT query_id, entity_id, id, [lpad(row_number() OVER (PARTITION BY query_id ORDER BY {order})::varchar, 12, '0')] AS key, 'memory:' || id AS path, false AS historical, 0 AS depth FROM {base}),
 {level(1, 'SELECT query_id, id FROM w0')}, {level(2, 'SELECT query_id, id FROM w0 UNION ALL SELECT query_id, id FROM w1')}"""


SQL_SEEDS = """seeds AS (SELECT entity_id AS query_id, entity_id, id, created_at FROM mem WHERE is_latest AND (valid_until IS NULL OR valid_until > timestamp '2024-02-01')
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id) <= 2)"""


@query("g12_multihop_walk", SQL_BASE + f", {SQL_FOUND}, {SQL_NB}, {SQL_SEEDS}, {sql_walk('seeds', 'created_at DESC, id')} SELECT query_id, id, depth, path, historical FROM w1 UNION ALL SELECT query_id, id, depth, path, historical FROM w2")
def g12(spark, d):
    """Two hops from the two newest memories of every source."""
    t = Tables(spark, d)
    order = Window.partitionBy("entity_id").orderBy(*newest())
    seeds = latest_memories(t.memories, NOW, 2).select(F.col("entity_id").alias("query_id"), "entity_id", "id", F.row_number().over(order).alias("position"))
    return graph.walk(seeds, t.memories, t.edges, t.mention_edges, 2).select("query_id", "id", "depth", graph.path_text().alias("path"), "historical")


@query("r6_hybrid_depth2", SQL_BASE + f", {SQL_FOUND}, {SQL_R1}, {SQL_R4}, {SQL_R5}, {SQL_NB}, {sql_expand('r13', 'r1')}, {sql_walk('r13', 'score DESC, depth, id')}, hop AS (SELECT w.query_id, w.entity_id, w.id, t.content, t.trust * pow(0.85::double, w.depth) AS score, 'memory_expanded' AS source, w.depth, NOT historical AS is_latest FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) w JOIN tr t ON t.id = w.id), "
       + sql_merge("SELECT * FROM r13 UNION ALL SELECT * FROM hop UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5"))
def r6d(spark, d):
    """Hybrid search with a walk of two hops."""
    return _hybrid(spark, d, depth=2)


@query("r7_rerank_embedding", SQL_HYBRID.replace("SELECT query_id, id, source, depth, " + r6("score"), "SELECT x.query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY y DESC, x.id)::int AS rank, " + r6("y") + " AS score FROM (SELECT m4.query_id, m4.id, 0.7::double * "
       + seed.sql_cosine("q.embedding", seed.sql_hash_embedding("m4.content")) + " + 0.3::double * m4.score AS y FROM m4 JOIN q USING (query_id) WHERE stopped = 0 AND rank <= m4.k) x --"))
def r7(spark, d):
    """Re-rank hybrid results by embedding."""
    t = Tables(spark, d)
    out = search.hybrid_search(t.queries, t.memories, t.embeddings, t.edges, t.mention_edges, t.fast_lane, NOW)
    ranked = search.rerank_by_embedding(out.drop("rank"), t.queries, lambda c: X.hash_embedding(c, seed.DIMS))
    return ranked.select("query_id", "id", "rank", X.fixed(F.col("score"), 6).alias("score"))


SQL_TOK = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-zA-Z0-9]+'), regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]')))"


@query("r8_rerank_keywords", SQL_HYBRID.replace("SELECT query_id, id, source, depth, " + r6("score"), "SELECT x.query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY y DESC, x.id)::int AS rank, " + r6("score") + " AS score FROM (SELECT m4.query_id, m4.id, m4.score, m4.score * (1.0::double + 0.15::double * len(list_intersect("
       + SQL_TOK.format("q.q") + ", " + SQL_TOK.format("m4.content") + ")) / len(" + SQL_TOK.format("q.q") + ")) AS y FROM m4 JOIN q USING (query_id) WHERE stopped = 0 AND rank <= m4.k) x --"))
def r8(spark, d):
    """Re-rank hybrid results by shared terms."""
    t = Tables(spark, d)
    out = search.hybrid_search(t.queries, t.memories, t.embeddings, t.edges, t.mention_edges, t.fast_lane, NOW)
    return search.rerank_by_keywords(out.drop("rank"), t.queries).select("query_id", "id", "rank", X.fixed(F.col("score"), 6).alias("score"))


SQL_FACTS = "memory_type IN ('fact', 'preference')"
SQL_KEYWORD = SQL_BASE + f""", {SQL_NB}, qt AS (SELECT query_id, entity_id, k, list_concat(regexp_extract_all(lower(q), '[a-zA-Z0-9]+'), regexp_extract_all(q, '[\\x{{4e00}}-\\x{{9fff}}]')) AS terms FROM q),
 s AS (SELECT query_id, qt.entity_id, k, t.id, t.content, len(list_filter(terms, lambda x: contains(lower(t.content), x)))::double / len(terms) AS m, trust FROM qt JOIN tr t USING (entity_id) WHERE {LIVE} AND {SQL_FACTS} AND confidence >= 0.3 AND len(terms) > 0),
 kw AS (SELECT query_id, entity_id, id, content, m * trust AS score, 'memory' AS source, 0 AS depth, true AS is_latest FROM s WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m * trust DESC, id) <= any_value(k) OVER (PARTITION BY query_id)),
 {sql_expand('r13', 'kw').replace('t.id = f.other) u', f't.id = f.other AND t.{SQL_FACTS}) u')}, """ + sql_merge("SELECT * FROM r13", False)
SQL_BOOSTED = ("SELECT x.query_id, x.id, x.source, row_number() OVER (PARTITION BY x.query_id ORDER BY y DESC, x.id)::int AS rank, " + r6("score") + " AS score FROM (SELECT m4.query_id, m4.id, m4.source, m4.score, m4.score * (1.0::double + 0.15::double * len(list_intersect("
               + SQL_TOK.format("q.q") + ", " + SQL_TOK.format("m4.content") + ")) / len(" + SQL_TOK.format("q.q") + ")) AS y FROM m4 JOIN q USING (query_id) WHERE stopped = 0 AND rank <= m4.k) x --")


@query("r6_keyword_path", SQL_KEYWORD.replace("SELECT query_id, id, source, depth, " + r6("score"), SQL_BOOSTED))
def r6k(spark, d):
    """The path without an embedder, filtered, with relations and re-rank."""
    t = Tables(spark, d)
    facts = {"$or": [{"memory_type": "fact"}, {"memory_type": "preference"}]}
    out = search.hybrid_search(t.queries, t.memories, None, t.edges, t.mention_edges, t.fast_lane, NOW, filters=facts, min_confidence=0.3, rerank=True)
    return out.select("query_id", "id", "source", "rank", X.fixed(F.col("score"), 6).alias("score"))


SQL_SHORT = "CASE item_id % 3 WHEN 0 THEN trim('如何' || text) || ' 方法 步骤' WHEN 1 THEN trim(substr(text, 1, 8)) || ' 相关信息' ELSE trim(text) END AS q"


@query("r6_rewritten_search", SQL_HYBRID.replace("text AS q, least(", SQL_SHORT + ", least(").replace("SELECT query_id, id, source, depth, " + r6("score"), "SELECT x.query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY y DESC, x.id)::int AS rank, " + r6("y") + " AS score FROM (SELECT m4.query_id, m4.id, 0.7::double * "
       + seed.sql_cosine("q.embedding", seed.sql_hash_embedding("m4.content")) + " + 0.3::double * m4.score AS y FROM m4 JOIN q USING (query_id) WHERE stopped = 0 AND rank <= m4.k) x --"))
def r6w(spark, d):
    """Queries expanded by their patterns, results re-ranked by embedding."""
    t = Tables(spark, d)
    n = F.regexp_extract("query_id", r"(\d+)", 1).cast("int") % 3
    asked = t.queries.withColumn("q", F.when(n == 0, F.concat(F.lit("如何"), "q")).when(n == 1, F.substring("q", 1, 8)).otherwise(F.col("q")))
    out = search.hybrid_search(asked, t.memories, t.embeddings, t.edges, t.mention_edges, t.fast_lane, NOW, rewrite=True, rerank=True, embed=lambda c: X.hash_embedding(c, seed.DIMS))
    return out.select("query_id", "id", "rank", X.fixed(F.col("score"), 6).alias("score"))


# ---------------------------------------------------------------- graph reads


@query("j3_u2_neighbours", SQL_BASE + f", {SQL_NB} SELECT entity_id, id, rel_type, other, other_latest FROM nb")
def j3(spark, d):
    """Every edge from both ends with the neighbour's state."""
    t = Tables(spark, d)
    return graph.neighbours(t.edges, t.memories).select("entity_id", "id", "rel_type", "other", "other_latest")


@query("j4_incoming_updates", SQL_BASE + " SELECT DISTINCT ed.entity_id, to_id AS id, from_id AS replaced_by FROM ed JOIN mem ON mem.id = to_id WHERE rel_type = 'UPDATES' AND NOT is_latest")
def j4(spark, d):
    """Who replaced the retired memories."""
    t = Tables(spark, d)
    return graph.replaced_by_whom(t.edges, t.memories.filter("NOT is_latest"))


@query("j10_update_lineage", f"""WITH RECURSIVE ed AS ({SQL_EDGE}), up AS (SELECT entity_id, to_id AS id, min(struct_pack(c := created_at, f := from_id)).f AS parent FROM ed WHERE rel_type = 'UPDATES' GROUP BY ALL),
 nodes AS (SELECT entity_id, id FROM up UNION SELECT entity_id, from_id FROM ed WHERE rel_type = 'UPDATES'),
 r AS (SELECT entity_id, id, id AS newest, 0::bigint AS steps FROM nodes UNION ALL SELECT r.entity_id, r.id, up.parent, steps + 1 FROM r JOIN up ON up.entity_id = r.entity_id AND up.id = r.newest)
SELECT entity_id, id, max_by(newest, steps) AS newest, max(steps) AS steps FROM r GROUP BY ALL""")
def j10(spark, d):
    """Newest version of every memory on an update chain."""
    return graph.update_lineage(Tables(spark, d).edges)


@query("g14_relation_lookup", f"WITH ed AS ({SQL_EDGE}) SELECT entity_id, from_id, to_id, conflict_id FROM ed WHERE rel_type = 'EXTENDS' AND conflict_id IN (SELECT 'k' || doc_id::varchar || '-60' FROM labels)")
def g14(spark, d):
    """Edges found by a property."""
    asked = seed.read(spark, d, "labels").select(F.concat(F.lit("k"), F.col("doc_id").cast("string"), F.lit("-60")).alias("value"))
    return graph.relations_with(Tables(spark, d).edges, "EXTENDS", "conflict_id", asked).select("entity_id", "from_id", "to_id", F.col("props")["conflict_id"].alias("conflict_id"))


@query("g14_relation_update", f"WITH ed AS ({SQL_EDGE}) SELECT entity_id, from_id, to_id, rel_type, conflict_id, CASE WHEN rel_type = 'UPDATES' THEN 'resolved' END AS status FROM ed")
def g14u(spark, d):
    """Set a property on edges."""
    edges = Tables(spark, d).edges
    changes = edges.filter("rel_type = 'UPDATES'").select("entity_id", "from_id", "to_id", "rel_type", F.lit("resolved").alias("value"))
    out = graph.set_relation_property(edges, changes, "status")
    return out.select("entity_id", "from_id", "to_id", "rel_type", F.col("props")["conflict_id"].alias("conflict_id"), F.col("props")["status"].alias("status"))


SQL_TAMPERED = """up AS (SELECT entity_id, to_id AS id, min(from_id) AS by FROM ed WHERE rel_type = 'UPDATES' GROUP BY ALL),
 mem2 AS (SELECT m.entity_id, m.id, m.doc_id, CASE WHEN up.id IS NOT NULL AND doc_id % 2 = 0 THEN false ELSE is_latest END AS is_latest, CASE WHEN doc_id % 3 = 0 THEN 'nobody' ELSE up.by END AS replaced_by FROM mem m LEFT JOIN up USING (entity_id, id)),
 ed2 AS (SELECT entity_id, from_id, to_id, rel_type FROM ed UNION ALL SELECT entity_id, id, id, 'EXTENDS' FROM mem WHERE doc_id % 97 = 0 UNION ALL SELECT 'elsewhere', from_id, to_id, rel_type FROM ed WHERE right(from_id, 1) = '7'),
 nd2 AS (SELECT entity_id, mention_id, count(*) + CASE WHEN right(mention_id, 1) = 'a' THEN 1 ELSE 0 END AS n, count(*) AS real FROM me GROUP BY entity_id, mention_id)"""


@query("g15_invariants", SQL_BASE + f", {SQL_FOUND}, {SQL_TAMPERED}" + """ SELECT 'update_target_live' AS kind, count(*) AS violations FROM ed2 e JOIN mem2 m ON m.id = e.to_id AND m.entity_id = e.entity_id WHERE rel_type = 'UPDATES' AND is_latest
 UNION ALL SELECT 'replaced_by_differs', count(*) FROM ed2 e JOIN mem2 m ON m.id = e.to_id AND m.entity_id = e.entity_id WHERE rel_type = 'UPDATES' AND NOT is_latest AND replaced_by IS NOT NULL AND replaced_by <> from_id
 UNION ALL SELECT 'self_loop', count(*) FROM ed2 WHERE from_id = to_id UNION ALL SELECT 'crosses_entity', count(*) FROM ed2 e JOIN mem2 m ON m.id = e.to_id WHERE m.entity_id <> e.entity_id
 UNION ALL SELECT 'mention_count_wrong', count(*) FROM nd2 WHERE n <> real""")
def g15(spark, d):
    """Violations of each kind in tables that were tampered with."""
    t = Tables(spark, d)
    n = F.substring("id", 2, 12).cast("bigint")
    by = t.edges.filter("rel_type = 'UPDATES'").groupBy("entity_id", F.col("to_id").alias("id")).agg(F.min("from_id").alias("_by"))
    memories = t.memories.join(by, ["entity_id", "id"], "left").withColumns({
        "is_latest": F.when(F.col("_by").isNotNull() & (n % 2 == 0), F.lit(False)).otherwise(F.col("is_latest")), "replaced_by": F.when(n % 3 == 0, "nobody").otherwise(F.col("_by")),
    })
    edges = t.edges.select("entity_id", "from_id", "to_id", "rel_type")
    loops = t.memories.filter(n % 97 == 0).select("entity_id", F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("EXTENDS").alias("rel_type"))
    foreign = edges.filter("right(from_id, 1) = '7'").withColumn("entity_id", F.lit("elsewhere"))
    nodes = mentions.mention_nodes(t.mention_edges).withColumn("mention_count", F.col("mention_count") + F.when(F.col("mention_id").endswith("a"), 1).otherwise(0))
    return graph.invariant_report(memories, edges.unionByName(loops).unionByName(foreign), t.mention_edges, nodes)
