"""Queries over profiles, forgetting, communities and consolidation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import communities, consolidate, graph, lifecycle, mentions, profile, search
from factloom.plans.catalog_relate import PAIR_UPDATES, sql_features
from factloom.plans.catalog_search import SQL_BASE, SQL_FOUND, SQL_R1, Tables
from factloom.plans.catalog_tables import SQL_TRUST, WITH_MEM, r6, stamp
from factloom.plans.registry import query
from factloom.sources import seed
from factloom.sources.seed import NOW, SQL_EDGE, SQL_EMB, SQL_FAST

TS = "'%Y-%m-%d %H:%M:%S'"


def sql_profile(static: str = "10", dynamic: str = "5", min_static: str = "0.5", min_dynamic: str = "0.3", days: str = "7") -> str:
    return f"""links AS (SELECT entity_id, to_id AS id, count(*) AS n FROM ed GROUP BY ALL),
 pool AS (SELECT * FROM tr WHERE is_latest AND (valid_until IS NULL OR valid_until > timestamp '2024-02-01')),
 scored AS (SELECT p.*, floor(least(0.35::double * trust + 0.25::double * pow(2.0::double, -(date_diff('second', created_at, timestamp '2024-02-01') / 86400.0::double) / 30.0::double)
   + 0.2::double * CASE memory_type WHEN 'preference' THEN 1.0 WHEN 'fact' THEN 0.8 WHEN 'episodic' THEN 0.5 WHEN 'noise' THEN 0.2 ELSE 0.5 END::double
   + 0.2::double * least(coalesce(l.n, 0) / 10.0::double, 1.0::double), 1.0::double) * 10000.0::double + 0.5) / 10000.0::double AS importance,
   CASE WHEN memory_type IN ('fact', 'preference') AND trust >= {min_static} THEN 'static' WHEN memory_type = 'episodic' AND trust >= {min_dynamic} AND created_at >= timestamp '2024-02-01' - to_days({days}) THEN 'dynamic' END AS kind
   FROM pool p LEFT JOIN links l USING (entity_id, id)),
 facts AS (SELECT * FROM (SELECT entity_id, kind, row_number() OVER (PARTITION BY entity_id, kind ORDER BY importance DESC, created_at DESC, id)::int AS rank, id AS memory_id, content, importance, created_at FROM scored WHERE kind IS NOT NULL)
   WHERE rank <= CASE kind WHEN 'static' THEN {static} ELSE {dynamic} END)"""


def _facts(t):
    return profile.profile_facts(t.memories, t.edges, NOW)


@query("q1_profile", SQL_BASE + f", {sql_profile()} SELECT entity_id, kind, rank, memory_id, content, importance, CASE kind WHEN 'dynamic' THEN '最近对话' END AS source, strftime(created_at, {TS}) AS created_at FROM facts")
def q1(spark, d):
    """Static and dynamic profile of every entity."""
    return _facts(Tables(spark, d)).withColumn("created_at", stamp("created_at"))


@query("q1_profile_summary", SQL_BASE + f", {sql_profile()} SELECT entity_id, count(*) AS memory_count, (SELECT count(*) FROM facts f WHERE f.entity_id = p.entity_id AND kind = 'static') AS static_facts, (SELECT count(*) FROM facts f WHERE f.entity_id = p.entity_id AND kind = 'dynamic') AS dynamic_facts FROM pool p GROUP BY ALL")
def q1s(spark, d):
    """Q1: counters of every profile."""
    t = Tables(spark, d)
    return profile.profile_summary(t.memories, _facts(t), NOW)


@query("x2_importance", SQL_BASE + f", {sql_profile()} SELECT id, importance FROM scored")
def x2(spark, d):
    """Importance of the memories a profile reads."""
    t = Tables(spark, d)
    from factloom.operators.scans import latest_memories
    pool = latest_memories(t.memories, NOW)
    links = t.edges.groupBy("entity_id", F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return pool.join(links, ["entity_id", "id"], "left").select("id", X.importance(NOW, X.trust(NOW), F.col("n")).alias("importance"))


def _config(t):
    e = F.regexp_extract("entity_id", r"(\d+)", 1).cast("int")
    return t.docs.select(F.col("source").alias("entity_id")).distinct().filter(e % 2 == 0).select(
        "entity_id", F.when(e % 4 == 0, 3).alias("static_max_items"), F.lit(0.7).alias("min_confidence_static"), F.when(e % 3 == 0, 60).alias("dynamic_lookback_days"))


EN = "regexp_extract(entity_id, '(\\d+)', 1)::int"


@query("q2_profile_config", SQL_BASE + f", {sql_profile(f'CASE WHEN {EN} % 4 = 0 THEN 3 ELSE 10 END', '5', f'CASE WHEN {EN} % 2 = 0 THEN 0.7 ELSE 0.5 END', '0.3', f'CASE WHEN {EN} % 6 = 0 THEN 60 ELSE 7 END')} SELECT entity_id, kind, rank, memory_id, importance FROM facts")
def q2(spark, d):
    """Q2: profiles under per-entity settings."""
    t = Tables(spark, d)
    return profile.profile_facts(t.memories, t.edges, NOW, _config(t)).select("entity_id", "kind", "rank", "memory_id", "importance")


SQL_INC = f""", {sql_profile()}, fresh AS (SELECT entity_id, id FROM mem WHERE created_at >= timestamp '2024-01-22'),
 gone AS (SELECT DISTINCT ed.entity_id, to_id AS memory_id FROM ed JOIN fresh f ON f.id = ed.from_id WHERE rel_type = 'UPDATES'),
 old AS (SELECT entity_id, kind, memory_id, importance, created_at FROM facts WHERE memory_id NOT IN (SELECT memory_id FROM gone) AND memory_id NOT IN (SELECT id FROM fresh)),
 added AS (SELECT entity_id, CASE WHEN memory_type IN ('fact', 'preference') AND trust >= 0.5 THEN 'static' WHEN memory_type = 'episodic' AND trust >= 0.3 AND created_at >= timestamp '2024-01-25' THEN 'dynamic' END AS kind, id AS memory_id, trust AS importance, created_at FROM tr WHERE id IN (SELECT id FROM fresh)),
 allf AS (SELECT * FROM old UNION ALL SELECT * FROM added WHERE kind IS NOT NULL)"""


@query("q3_incremental_profile", SQL_BASE + SQL_INC + f""" SELECT entity_id, kind, rank, memory_id, {r6('importance')} AS importance FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY importance DESC, created_at DESC, memory_id)::int AS rank FROM allf)
 WHERE rank <= CASE kind WHEN 'static' THEN 10 ELSE 5 END""")
def q3(spark, d):
    """Q3: profiles refreshed by the memories of the last ten days."""
    t = Tables(spark, d)
    fresh = t.memories.filter(F.col("created_at") >= X.at("2024-01-22 00:00:00")).select("entity_id", "id")
    before = _facts(t).join(fresh.withColumnRenamed("id", "memory_id"), ["entity_id", "memory_id"], "left_anti")
    return profile.merge_incremental(before, t.memories, t.edges, fresh, NOW).select("entity_id", "kind", "rank", "memory_id", X.fixed(F.col("importance"), 6).alias("importance"))


@query("q4_entity_digest", SQL_BASE + f""", {sql_profile()},
 rec AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY internal_type IS NULL, created_at DESC, id) AS rank FROM mem WHERE is_latest AND (valid_until IS NULL OR valid_until > timestamp '2024-02-01') AND created_at > timestamp '2024-01-25' AND memory_type <> 'fact' QUALIFY rank <= 10),
 s AS (SELECT entity_id, string_agg('- ' || content, E'\\n' ORDER BY rank) AS x FROM facts WHERE kind = 'static' GROUP BY 1),
 y AS (SELECT entity_id, string_agg('- ' || content || ' (source: 最近对话)', E'\\n' ORDER BY rank) AS x FROM facts WHERE kind = 'dynamic' GROUP BY 1),
 z AS (SELECT entity_id, string_agg('- ' || content || ' _(' || coalesce(internal_type, memory_type) || ')_', E'\\n' ORDER BY rank) AS x FROM rec GROUP BY 1),
 c AS (SELECT entity_id, count(*) AS n FROM pool GROUP BY 1)
SELECT c.entity_id, '# Memory Summary: ' || c.entity_id || E'\\n\\n_Generated at 2024-02-01T00:00:00_\\n\\n' || CASE WHEN s.x IS NULL THEN E'## Static Facts\\n\\n_No static facts yet._\\n\\n' ELSE E'## Static Facts\\n\\n' || s.x || E'\\n\\n' END
 || CASE WHEN y.x IS NULL THEN '' ELSE E'## Recent Context\\n\\n' || y.x || E'\\n\\n' END || CASE WHEN z.x IS NULL THEN '' ELSE E'## Recent Memories\\n\\n' || z.x || E'\\n\\n' END || E'---\\n_Total memories: ' || n::varchar || '_' AS digest
FROM c LEFT JOIN s USING (entity_id) LEFT JOIN y USING (entity_id) LEFT JOIN z USING (entity_id)""")
def q4(spark, d):
    """Q4: Markdown digest of every entity."""
    t = Tables(spark, d)
    return profile.digest(_facts(t), t.memories, NOW)


@query("q5_space_create", """SELECT DISTINCT source AS entity_id, tag, name FROM documents, (VALUES ('default', 'Default'), ('my-trips', 'My Trips'), ('work', 'Work')) s(tag, name)""")
def q5(spark, d):
    """Q5: create spaces; existing tags stay."""
    base = Tables(spark, d).docs.select(F.col("source").alias("entity_id")).distinct()
    old = base.select("entity_id", F.explode(F.array(F.struct(F.lit("default").alias("tag"), F.lit("Default").alias("name")), F.struct(F.lit("work").alias("tag"), F.lit("Work").alias("name")))).alias("s")).select("entity_id", "s.tag", "s.name")
    asked = base.select("entity_id", F.explode(F.array(F.lit("WORK"), F.lit("My Trips"))).alias("name"))
    return profile.create_spaces(old, asked)


@query("q5_space_delete", WITH_MEM + "SELECT id, CASE WHEN container_tag = 'work' THEN NULL ELSE container_tag END AS container_tag FROM mem")
def q5d(spark, d):
    """Q5: delete a space of every entity and detach its memories."""
    t = Tables(spark, d)
    gone = t.memories.filter("container_tag = 'work'").select("entity_id", F.col("container_tag").alias("tag")).distinct()
    return profile.delete_spaces(gone.withColumn("name", F.lit("Work")), t.memories, gone)[1].select("id", "container_tag")


def _three_spaces(t):
    tags = F.explode(F.array(*[F.struct(F.lit(a).alias("tag"), F.lit(b).alias("name")) for a, b in (("default", "Default"), ("work", "Work"), ("trips", "Trips"))]))
    return t.docs.select(F.col("source").alias("entity_id")).distinct().select("entity_id", tags.alias("s")).select("entity_id", "s.tag", "s.name")


SQL_SPACES = "sp AS (SELECT DISTINCT source AS entity_id, tag, name FROM documents, (VALUES ('default', 'Default'), ('work', 'Work'), ('trips', 'Trips')) s(tag, name))"


@query("q5_space_rename", f"WITH {SQL_SPACES} SELECT entity_id, tag, CASE WHEN tag = 'work' AND right(entity_id, 1) <> '3' THEN 'Office' ELSE name END AS name FROM sp")
def q5r(spark, d):
    """Q5: new names for one space of most entities; tags stay."""
    spaces = _three_spaces(Tables(spark, d))
    names = spaces.filter("tag = 'work' AND right(entity_id, 1) <> '3'").select("entity_id", "tag", F.lit("Office").alias("name"))
    return profile.rename_spaces(spaces, names).select("entity_id", "tag", "name")


@query("q5_spaces_left", WITH_MEM + f", {SQL_SPACES} SELECT entity_id, tag, name FROM sp WHERE tag <> 'work' OR NOT EXISTS (SELECT 1 FROM mem WHERE mem.entity_id = sp.entity_id AND container_tag = 'work')")
def q5l(spark, d):
    """Q5: spaces that remain after a deletion."""
    t = Tables(spark, d)
    gone = t.memories.filter("container_tag = 'work'").select("entity_id", F.col("container_tag").alias("tag")).distinct()
    return profile.delete_spaces(_three_spaces(t), t.memories, gone)[0].select("entity_id", "tag", "name")


@query("r9_context_block", SQL_BASE + f""", {SQL_R1}, {sql_profile()},
 h AS (SELECT entity_id, string_agg('- ' || content, E'\\n' ORDER BY rank) AS x FROM (SELECT *, sum(length(content) + 2) OVER (PARTITION BY entity_id ORDER BY rank) AS run FROM facts WHERE kind = 'static') WHERE run <= 1500 GROUP BY 1),
 r AS (SELECT query_id, string_agg('* ' || content, E'\\n' ORDER BY score DESC, id) AS x FROM r1 GROUP BY 1)
SELECT q.query_id, q.entity_id, CASE WHEN h.x IS NULL THEN coalesce(r.x, '') WHEN r.x IS NULL THEN h.x ELSE h.x || E'\\n\\n' || r.x END AS context FROM q LEFT JOIN h USING (entity_id) LEFT JOIN r USING (query_id)""")
def r9(spark, d):
    """Context text per query, profile before memories."""
    t = Tables(spark, d)
    hits = search.vector_search(t.queries, t.memories, t.embeddings, NOW)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return search.context_block(_facts(t), hits, t.queries)


# ---------------------------------------------------------------- forgetting

SQL_F123 = """f1 AS (SELECT id, 'expired' AS reason FROM mem WHERE is_latest AND valid_until < timestamp '2024-02-01'),
 f2 AS (SELECT id, 'noise_filtered' AS reason FROM mem WHERE is_latest AND confidence < 0.3 AND created_at < timestamp '2024-01-25'),
 f3 AS (SELECT id, 'episodic_decay' AS reason FROM mem WHERE is_latest AND memory_type = 'episodic' AND created_at < timestamp '2024-02-01' - interval 90 day)"""


@query("f1_time_expiry", WITH_MEM + f", {SQL_F123} SELECT * FROM f1")
def f1(spark, d):
    """memories past their validity."""
    return lifecycle.expired(Tables(spark, d).memories, NOW).select("id", "reason")


@query("f2_noise_filter", WITH_MEM + f", {SQL_F123} SELECT * FROM f2")
def f2(spark, d):
    """weak memories older than a week."""
    return lifecycle.noise(Tables(spark, d).memories, NOW).select("id", "reason")


@query("f3_episodic_decay", WITH_MEM + f", {SQL_F123} SELECT * FROM f3")
def f3(spark, d):
    """episodic memories older than 90 days."""
    return lifecycle.faded_episodes(Tables(spark, d).memories, NOW).select("id", "reason")


def _base(t):
    return lifecycle.MemoryBase(t.memories, t.edges, t.mention_edges, mentions.mention_nodes(t.mention_edges), t.embeddings)


@query("f0_mark_expired", WITH_MEM + f", {SQL_F123} SELECT mem.id, is_latest AND f1.id IS NULL AS is_latest, f1.reason AS replaced_by, CASE WHEN f1.id IS NOT NULL THEN '2024-02-01 00:00:00' END AS expired_at FROM mem LEFT JOIN f1 ON f1.id = mem.id")
def f0(spark, d):
    """memories after expiry."""
    t = Tables(spark, d)
    return lifecycle.mark_expired(_base(t), lifecycle.expired(t.memories, NOW), NOW).memories.select("id", "is_latest", "replaced_by", stamp("expired_at"))


@query("f0_mentions_after", WITH_MEM + f", {SQL_FOUND}, {SQL_F123} SELECT entity_id, mention_id, count(*) AS mention_count FROM me WHERE memory_id NOT IN (SELECT id FROM f1) GROUP BY ALL")
def f0m(spark, d):
    """Mention nodes after expiry."""
    t = Tables(spark, d)
    return lifecycle.mark_expired(_base(t), lifecycle.expired(t.memories, NOW), NOW).mentions.select("entity_id", "mention_id", "mention_count")


@query("f10_fast_lane_archive", f"WITH fl AS ({SQL_FAST}) SELECT id, CASE WHEN stage = 'fast_lane' AND created_at <= timestamp '2024-01-31' THEN 'archived' ELSE stage END AS stage, CASE WHEN stage = 'fast_lane' AND created_at <= timestamp '2024-01-31' THEN '2024-02-01 00:00:00' END AS archived_at FROM fl")
def f10(spark, d):
    """fast-lane rows archived by age."""
    return lifecycle.archive_fast_lane(Tables(spark, d).fast_lane, NOW).select("id", "stage", stamp("archived_at"))


@query("f10_archive_indexed", f"WITH fl AS ({SQL_FAST}), x AS (SELECT *, stage = 'fast_lane' AND (created_at <= timestamp '2024-01-31' OR sha256(id) < '8') AS gone FROM fl) SELECT id, CASE WHEN gone THEN 'archived' ELSE stage END AS stage, CASE WHEN gone THEN '2024-02-01 00:00:00' END AS archived_at FROM x")
def f10i(spark, d):
    """fast-lane rows archived by age or because their text is indexed."""
    rows = Tables(spark, d).fast_lane
    return lifecycle.archive_fast_lane(rows, NOW, indexed=rows.filter(F.sha2("id", 256) < "8").select("id")).select("id", "stage", stamp("archived_at"))


# ---------------------------------------------------------------- communities

SQL_ADJ = f"""nodes AS (SELECT * FROM mem WHERE is_latest),
 lk AS (SELECT DISTINCT entity_id, memory_id, mention_id FROM me),
 adj AS (SELECT DISTINCT x.entity_id, x.a, x.b FROM (SELECT entity_id, from_id AS a, to_id AS b FROM ed UNION ALL SELECT entity_id, to_id, from_id FROM ed
   UNION ALL SELECT p.entity_id, p.memory_id, q.memory_id FROM lk p JOIN lk q USING (entity_id, mention_id) WHERE p.memory_id <> q.memory_id) x JOIN nodes n ON n.id = x.a JOIN nodes m ON m.id = x.b)"""
SQL_PART = """part AS (SELECT *, 'p' || ((doc_id // 20) % 5)::varchar AS community FROM nodes),
 rows AS (SELECT p.entity_id, p.id, p.community, p.confidence, p.created_at, p.last_accessed_at, coalesce(d.degree, 0) AS degree, coalesce(d.inside, 0) AS inside, coalesce(d.reached, 0) AS reached FROM part p LEFT JOIN (
   SELECT a.a AS id, count(*) AS degree, count(*) FILTER (WHERE x.community = y.community) AS inside, count(DISTINCT y.community) AS reached FROM adj a JOIN part x ON x.id = a.a JOIN part y ON y.id = a.b GROUP BY ALL) d USING (id))"""


def _members(t):
    """Participants under a fixed partition, with link counts and protection."""
    pool = communities.participants(t.memories).withColumn("part", F.concat(F.lit("p"), (F.floor(F.substring("id", 2, 12).cast("bigint") / 20) % 5).cast("string")))
    found = communities.analyse(communities.links(pool, t.edges, t.mention_edges, "part"))
    rows = pool.select("entity_id", "id", "confidence", "created_at", "last_accessed_at").join(found, ["entity_id", "id"])
    return communities.protection(rows, _facts(t))


@query("g11_adjacency", SQL_BASE + f", {SQL_FOUND}, {SQL_ADJ}, {SQL_PART} SELECT entity_id, id, degree FROM rows")
def g11(spark, d):
    """Neighbours of every participant over edges and shared mentions."""
    t = Tables(spark, d)
    return communities.analyse(communities.links(communities.participants(t.memories), t.edges, t.mention_edges)).select("entity_id", "id", "degree")


SQL_SCORE = SQL_BASE + f", {SQL_FOUND}, {SQL_ADJ}, {SQL_PART}, {sql_profile()}" + """, prot AS (SELECT r.*, f.memory_id IS NOT NULL AS protected FROM rows r LEFT JOIN (SELECT DISTINCT memory_id FROM facts) f ON f.memory_id = r.id),
 sc AS (SELECT entity_id, community, count(*) AS size, count(*) FILTER (WHERE protected) AS protected_members, count(*) FILTER (WHERE reached >= 2) AS bridges,
  floor(least(1.0::double, 0.3::double * avg(least(1.0::double, greatest(0.0::double, confidence))) + 0.3::double * pow(2.0::double, -greatest(0.0::double, date_diff('second', max(greatest(created_at, coalesce(last_accessed_at, created_at))), timestamp '2024-02-01') / 86400.0::double) / 30.0::double)
   + 0.2::double * CASE WHEN count(*) < 2 THEN 0.0::double ELSE sum(inside)::double / (count(*) * (count(*) - 1)) END + 0.2::double * avg(CASE WHEN protected THEN 1.0::double ELSE 0.0::double END)) * 1000000.0::double + 0.5) / 1000000.0::double AS score FROM prot GROUP BY ALL),
 vd AS (SELECT *, CASE WHEN score >= 0.5 THEN 'keep' WHEN protected_members > 0 THEN 'exempt_profile' WHEN bridges > 0 THEN 'exempt_bridge' ELSE 'forgotten' END AS action FROM sc) """


@query("a5_c2_community_score", SQL_SCORE + "SELECT entity_id, community, size, score, protected_members, bridges FROM sc")
def a5(spark, d):
    """Activity of communities under a fixed partition."""
    return communities.scores(_members(Tables(spark, d)), NOW)


@query("a6_c3_bridges", SQL_BASE + f", {SQL_FOUND}, {SQL_ADJ}, {SQL_PART} SELECT entity_id, id, reached FROM rows WHERE reached >= 2")
def a6(spark, d):
    """Memories whose neighbours lie in two or more communities."""
    return _members(Tables(spark, d)).filter("reached >= 2").select("entity_id", "id", "reached")


@query("c4_p6_verdicts", SQL_SCORE + "SELECT entity_id, community, action FROM vd")
def c4(spark, d):
    """Verdict per community."""
    return communities.verdicts(communities.scores(_members(Tables(spark, d)), NOW)).select("entity_id", "community", "action")


@query("u3_forgotten_members", SQL_SCORE + "SELECT r.entity_id, r.id FROM rows r JOIN vd USING (entity_id, community) WHERE action = 'forgotten' OR (action = 'exempt_bridge' AND reached < 2)")
def u3(spark, d):
    """Members to forget."""
    members = _members(Tables(spark, d))
    return communities.forgotten_members(members, communities.verdicts(communities.scores(members, NOW)))


@query("a2_verdict_counts", SQL_SCORE + "SELECT action, count(*) AS communities FROM vd GROUP BY ALL")
def a2(spark, d):
    """A2: decisions by action."""
    return communities.verdicts(communities.scores(_members(Tables(spark, d)), NOW)).groupBy("action").agg(F.count(F.lit(1)).alias("communities"))


@query("w7_relabel", SQL_BASE + f", {SQL_ADJ.split(', adj AS')[0].split(',' + chr(10) + ' lk AS')[0]}, part AS (SELECT *, 'p' || ((doc_id // 20) % 5)::varchar AS community FROM nodes), mn AS (SELECT entity_id, community, min(id) AS m FROM part GROUP BY ALL), nm AS (SELECT *, 'c' || (dense_rank() OVER (PARTITION BY entity_id ORDER BY m) - 1)::varchar AS name FROM mn) SELECT part.entity_id, part.id, name AS community FROM part JOIN nm USING (entity_id, community)")
def w7(spark, d):
    """Communities renamed by their smallest member."""
    pool = communities.participants(Tables(spark, d).memories)
    part = pool.select("entity_id", "id", F.concat(F.lit("p"), (F.floor(F.substring("id", 2, 12).cast("bigint") / 20) % 5).cast("string")).alias("community"))
    return communities.relabel(part).select("entity_id", "id", "community")


def sql_propagation(sweeps: int = 12) -> str:
    """Label propagation of two half steps per sweep, unrolled; settled states stay as they are."""
    out = ["rel AS (SELECT DISTINCT entity_id, a, b FROM (SELECT entity_id, from_id AS a, to_id AS b FROM ed UNION ALL SELECT entity_id, to_id, from_id FROM ed) x JOIN nodes n USING (entity_id) JOIN nodes m USING (entity_id) WHERE n.id = a AND m.id = b AND a <> b)",
           "mm AS (SELECT lk.entity_id, lk.memory_id AS id, lk.mention_id FROM lk JOIN nodes n ON n.entity_id = lk.entity_id AND n.id = lk.memory_id QUALIFY count(*) OVER (PARTITION BY lk.entity_id, lk.mention_id) > 1)", "l0 AS MATERIALIZED (SELECT entity_id, id, id AS label FROM nodes)"]
    for k in range(1, 2 * sweeps + 1):
        old, half = f"l{k - 1}", "<" if k % 2 else ">="
        out.append(f"""s{k} AS MATERIALIZED (SELECT entity_id, mention_id, label FROM (SELECT mm.entity_id, mention_id, label, count(*) AS n FROM mm JOIN {old} USING (entity_id, id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id, mention_id ORDER BY n DESC, label) = 1),
 l{k} AS MATERIALIZED (SELECT o.entity_id, o.id, CASE WHEN substr(md5(o.id), 1, 1) {half} '8' THEN w.label ELSE o.label END AS label FROM {old} o JOIN (SELECT entity_id, id, label FROM (
  SELECT entity_id, id, label, count(*) AS n FROM (SELECT entity_id, id, label FROM {old} UNION ALL SELECT rel.entity_id, rel.a, {old}.label FROM rel JOIN {old} ON {old}.entity_id = rel.entity_id AND {old}.id = rel.b
   UNION ALL SELECT mm.entity_id, mm.id, s{k}.label FROM mm JOIN s{k} USING (entity_id, mention_id)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id, id ORDER BY n DESC, label) = 1) w USING (entity_id, id))""")
    last = f"l{2 * sweeps}"
    out.append(f"named AS (SELECT l.entity_id, l.id, 'c' || (dense_rank() OVER (PARTITION BY l.entity_id ORDER BY m) - 1)::varchar AS community FROM {last} l JOIN (SELECT entity_id, label, min(id) AS m FROM {last} GROUP BY ALL) USING (entity_id, label))")
    return ", ".join(out)


SQL_FOUND_PART = sql_propagation() + ", " + SQL_PART.replace("part AS (SELECT *, 'p' || ((doc_id // 20) % 5)::varchar AS community FROM nodes)", "part AS (SELECT n.*, named.community FROM nodes n JOIN named USING (entity_id, id))")


@query("c1_community_detection", SQL_BASE + f", {SQL_FOUND}, {SQL_ADJ}, {SQL_FOUND_PART} SELECT entity_id, id, community, degree FROM rows")
def c1(spark, d):
    """Label propagation over relations and shared mentions."""
    t = Tables(spark, d)
    pool = communities.participants(t.memories)
    return communities.relabel(communities.analyse(communities.links(pool, t.edges, t.mention_edges))).select("entity_id", "id", "community", "degree")


@query("c1_settled", "SELECT true AS settled")
def c1_settled(spark, d):
    """Whether the propagation settled."""
    t = Tables(spark, d)
    linked = communities.links(communities.participants(t.memories), t.edges, t.mention_edges)
    settled = communities.propagate(linked)[1]
    return t.docs.limit(1).select(F.lit(settled).alias("settled"))


@query("f4_forget_communities", SQL_SCORE.replace(SQL_PART, SQL_FOUND_PART) + "SELECT r.entity_id, r.id, 'community_forgotten' AS reason FROM rows r JOIN vd USING (entity_id, community) WHERE action = 'forgotten' OR (action = 'exempt_bridge' AND reached < 2)")
def f4(spark, d):
    """detect, score and decide communities, then list what is forgotten."""
    return lifecycle.forget_communities(_base(Tables(spark, d)), NOW)[1]


@query("f11_maintenance_run")
def f11(spark, d):
    """whole maintenance run, one row per strategy and action."""
    return lifecycle.maintain(_base(Tables(spark, d)), NOW)[1]


# ---------------------------------------------------------------- consolidation


class ByLanguage(Tables):
    """The same tables with the language as entity, so that copies meet."""

    def __init__(self, spark, d):
        super().__init__(spark, d)
        self.docs = self.docs.withColumn("source", F.col("lang"))


def _lang_sql(sql: str) -> str:
    marker = "FROM (SELECT * REPLACE (lang AS source) FROM documents)"
    out = sql.replace("FROM documents n,", "FROM @D n,").replace(") s, documents o", ") s, @D o").replace("FROM documents", "FROM @D")
    return out.replace("@D", marker[5:])


SQL_PAIRS = _lang_sql(WITH_MEM) + ", tr AS (SELECT *, " + SQL_TRUST + f" AS trust FROM mem), e AS ({_lang_sql(SQL_EMB)}), ed AS ({_lang_sql(SQL_EDGE)}), {sql_profile()}" + """,
 pv AS (SELECT tr.entity_id, tr.id, e.embedding FROM tr JOIN e ON e.entity_id = tr.entity_id AND e.chunk_id = tr.id AND e.document_id IS NULL WHERE is_latest),
 ve AS (SELECT DISTINCT entity_id, embedding FROM pv),
 nn AS (SELECT * FROM (SELECT p.entity_id, p.embedding AS x, v.embedding AS y, CASE WHEN p.embedding = v.embedding THEN 1.0::double ELSE floor(coalesce(list_cosine_similarity(p.embedding::double[], v.embedding::double[]), 0.0) * 1000000000.0::double + 0.5) / 1000000000.0::double END AS score FROM ve p JOIN ve v USING (entity_id)) WHERE score >= 0.9),
 cp AS (SELECT nn.entity_id, p.id AS a, q.id AS b, score AS similarity FROM nn JOIN pv p ON p.entity_id = nn.entity_id AND p.embedding = nn.x JOIN pv q ON q.entity_id = nn.entity_id AND q.embedding = nn.y WHERE p.id < q.id) """


@query("f5_j8_duplicate_pairs", SQL_PAIRS + f"SELECT entity_id, a, b, {r6('similarity')} AS similarity FROM cp")
def f5(spark, d):
    """All close pairs of live memories."""
    t = ByLanguage(spark, d)
    classes, near = consolidate.guard_classes(t.memories, t.embeddings, NOW, t.edges, _facts(t))
    return consolidate.every_pair(consolidate.class_pairs(classes, near), classes).withColumn("similarity", X.fixed(F.col("similarity"), 6))


def _veto(n: str, o: str) -> str:
    return "(" + PAIR_UPDATES.replace("{guard}", "").replace("n.", f"{n}.").replace("o.", f"{o}.") + ")"


SQL_JUDGED = SQL_PAIRS + f""", f AS ({sql_features("(SELECT tr.*, fx.memory_id IS NOT NULL AS protected FROM tr LEFT JOIN (SELECT DISTINCT memory_id FROM facts) fx ON fx.memory_id = tr.id)")}),
 jp AS (SELECT cp.*, n, o, list_intersect(n.big, o.big) AS sh, len(n.big) > 0 AND len(o.big) > 0 AND (len(list_intersect(n.big, o.big)) >= 2 OR list_has_any(n.subj, o.subj)) AS ov FROM (SELECT cp.*, fa AS n, fb AS o FROM cp JOIN f fa ON fa.id = cp.a JOIN f fb ON fb.id = cp.b) cp),
 jd AS (SELECT entity_id, a, b, n.trust AS a_trust, o.trust AS b_trust, n.created_at AS a_created, o.created_at AS b_created, CASE WHEN n.memory_type <> o.memory_type THEN 'exempt_type' WHEN n.protected OR o.protected THEN 'exempt_profile' WHEN {_veto('n', 'o')} OR {_veto('o', 'n')} THEN 'exempt_contradiction'
   WHEN EXISTS (SELECT 1 FROM ed WHERE rel_type = 'UPDATES' AND least(from_id, to_id) = a AND greatest(from_id, to_id) = b) THEN 'exempt_updates' ELSE 'consolidated' END AS action FROM jp) """


@query("f6_pair_verdicts", SQL_JUDGED + "SELECT entity_id, a, b, action FROM jd")
def f6(spark, d):
    """verdict per close pair, judged once per pair of classes."""
    t = ByLanguage(spark, d)
    facts = _facts(t)
    classes, near = consolidate.guard_classes(t.memories, t.embeddings, NOW, t.edges, facts)
    judged = consolidate.judge_pairs(consolidate.class_pairs(classes, near), t.memories, t.edges, facts, NOW)
    return consolidate.every_pair(judged.select("entity_id", "a", "b", "action"), classes)


SQL_GROUPS = SQL_JUDGED.replace("WITH mem", "WITH RECURSIVE mem", 1) + """, good AS (SELECT * FROM jd WHERE action = 'consolidated'), lnk AS (SELECT a AS x, b AS y FROM good UNION SELECT b, a FROM good),
 reach AS (SELECT x, x AS y FROM lnk UNION SELECT r.x, l.y FROM reach r JOIN lnk l ON l.x = r.y), grp AS (SELECT x AS id, min(y) AS label FROM reach GROUP BY 1),
 gm AS (SELECT g.id, g.label, t.entity_id, first_value(g.id) OVER (PARTITION BY g.label ORDER BY t.trust DESC, t.created_at DESC, g.id) AS representative FROM grp g JOIN tr t USING (id)),
 mg AS (SELECT gm.* FROM gm JOIN good ON good.a = least(gm.id, gm.representative) AND good.b = greatest(gm.id, gm.representative) WHERE gm.id <> gm.representative) """


@query("f7_w5_duplicate_groups", SQL_GROUPS + "SELECT entity_id, id, label, representative FROM gm")
def f7(spark, d):
    """Duplicate groups with their representative."""
    judged, _ = lifecycle.consolidate_duplicates(_base(ByLanguage(spark, d)), NOW)
    return consolidate.representatives(judged)


@query("f8_land_merges", SQL_GROUPS + "SELECT entity_id, id, representative FROM mg")
def f8(spark, d):
    """F8: members that merge into their representative."""
    return lifecycle.consolidate_duplicates(_base(ByLanguage(spark, d)), NOW)[1].select("entity_id", "id", "representative")


@query("f9_edge_rewrite", SQL_GROUPS + """SELECT ed.entity_id, CASE WHEN mv AND NOT own AND mf.id IS NOT NULL AND (NOT sib OR from_id < to_id) THEN mf.representative ELSE from_id END AS from_id,
 CASE WHEN mv AND NOT own AND mt.id IS NOT NULL AND (NOT sib OR to_id < from_id) THEN mt.representative ELSE to_id END AS to_id, rel_type FROM (SELECT *, rel_type <> 'UPDATES' AS mv FROM ed) ed LEFT JOIN mg mf ON mf.id = from_id LEFT JOIN mg mt ON mt.id = to_id,
 LATERAL (SELECT coalesce(mf.representative = to_id, false) OR coalesce(mt.representative = from_id, false) AS own, coalesce(mf.label = mt.label, false) AS sib) z""")
def f9(spark, d):
    """relation edges after consolidation."""
    t = ByLanguage(spark, d)
    merged = lifecycle.consolidate_duplicates(_base(t), NOW)[1]
    return consolidate.rewrite_relations(t.edges, merged).select("entity_id", "from_id", "to_id", "rel_type")


@query("f9_mention_rewrite", SQL_GROUPS + f""", {SQL_FOUND} SELECT DISTINCT me.entity_id, coalesce(mg.representative, me.memory_id) AS memory_id, mention_id, surface_form FROM me LEFT JOIN mg ON mg.id = me.memory_id""")
def f9m(spark, d):
    """MENTIONS edges after consolidation."""
    t = ByLanguage(spark, d)
    merged = lifecycle.consolidate_duplicates(_base(t), NOW)[1]
    return consolidate.rewrite_mentions(t.mention_edges, merged).select("entity_id", "memory_id", "mention_id", "surface_form")


@query("f9_retired_members", SQL_GROUPS + "SELECT m.id, m.is_latest AND mg.id IS NULL AS is_latest, mg.representative AS replaced_by FROM mem m LEFT JOIN mg ON mg.id = m.id")
def f9r(spark, d):
    """memories after consolidation."""
    t = ByLanguage(spark, d)
    merged = lifecycle.consolidate_duplicates(_base(t), NOW)[1]
    return consolidate.retire_merged(t.memories, merged, NOW).select("id", "is_latest", "replaced_by")
