"""Queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import centroids, decontaminate, langid, packing, phrases, pieces, piecewise, quality, secret_scan, simhash, suffix_dedup, token_counts, warc_zip
from factloom.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.fit(docs.filter(F.coalesce(~held_out, F.lit(True))).select("text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 99 AS e FROM numbered GROUP BY doc_id, r),
parts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - 1 - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s + 1) AS gone, count(*) AS spans FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_suffix_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


@query("op4_piecewise_hash")
def op4(spark, sf_dir):
    return piecewise.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), met AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op6_decontamination", OP6_SQL)
def op6(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_matches(kind: str, rank: int, pattern: str, where: str = "true") -> str:
    """Matches with their places: text pieces between them give the offsets."""
    quoted = pattern.replace("'", "''")
    plain = quoted.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")
    return f"""{kind} AS (SELECT * FROM (SELECT doc_id, {rank} AS rank, list_sum(list_transform(parts[1:j], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:j - 1], lambda x: length(x))), 0)::BIGINT AS s, found[j] AS m
 FROM (SELECT doc_id, regexp_extract_all(t, '{plain}') AS found, string_split_regex(t, '{plain}') AS parts, unnest(generate_series(1, len(regexp_extract_all(t, '{plain}')))) AS j FROM d)) WHERE {where})"""


def op7_sql() -> str:
    scan = secret_scan
    value = scan.ASSIGN.replace("'", "''")
    out = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)", _sql_matches("assign", 0, scan.ASSIGN, f"length(regexp_extract(m, '{value}', 1)) >= 12"), _sql_matches("access", 1, scan.ACCESS), _sql_matches("hex", 2, scan.HEX)]
    out.append("base AS (SELECT doc_id, rank, s, s + length(m) AS e FROM (FROM assign UNION ALL FROM access UNION ALL FROM hex))")
    for k, (kind, (pattern, _, bound)) in enumerate(scan.CLASSES.items()):
        allow = scan.ALLOW.replace("'", "''")
        out.append(_sql_matches(kind, 3 + k, pattern, f"NOT regexp_matches(m, '{allow}')"))
        out.append(f"""{kind}_hot AS (SELECT doc_id, rank, s, m, i FROM (SELECT *, unnest(range(length(m) - {scan.WINDOW - 1})) AS i FROM {kind})
 WHERE list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, i::INT + 1, {scan.WINDOW}), ''), 'histogram')), lambda c: c * log2(c))) <= {scan.WINDOW} * (log2({scan.WINDOW}) - {bound}))""")
        allow_run = scan.ALLOW_RUN.replace("'", "''")
        out.append(f"""{kind}_run AS (SELECT doc_id, rank, s + a AS s, s + b AS e FROM (SELECT doc_id, rank, s, any_value(m) AS m, min(i)::INT AS a, max(i)::INT + {scan.WINDOW} AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY i) AS r FROM (
 SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) + {scan.WINDOW} THEN 0 ELSE 1 END AS fresh FROM {kind}_hot)) GROUP BY doc_id, rank, s, r)
 WHERE NOT regexp_matches(regexp_extract(substr(m, 1, a), '[A-Za-z0-9]*$') || substr(m, a + 1, b - a) || regexp_extract(substr(m, b + 1), '^[A-Za-z0-9]*'), '{allow_run}'))""")
    runs = " UNION ALL ".join(f"SELECT doc_id, rank, s, e FROM {k}_run" for k in scan.CLASSES)
    out.append(f"every AS (SELECT doc_id, rank, s, e FROM base UNION ALL SELECT * FROM ({runs}) r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.e <= b.e))")
    names = ", ".join(f"'{k}'" for k in (*scan.BASE_KINDS, *scan.CLASSES))
    shown = f"string_agg(([{names}])[rank + 1] || ':' || s::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY s, rank, e)"
    out.append(f"b AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, {shown} AS x FROM base GROUP BY doc_id)")
    out.append(f"a AS (SELECT doc_id, {shown} AS spans FROM every GROUP BY doc_id)")
    return "WITH " + ", ".join(out) + """ SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(x, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


@query("op7_secret_scan", op7_sql())
def op7(spark, sf_dir):
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', x) - 3, 4)), '') AS bits FROM p),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT
    + 4 * substr(bits, 5 * i::INT + 3, 1)::INT + 2 * substr(bits, 5 * i::INT + 4, 1)::INT + substr(bits, 5 * i::INT + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM b JOIN m USING (h)
"""


@query("op9_warc", OP9_SQL)
def op9(spark, sf_dir):
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


@query("op10_simhash")
def op10(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds written out; a centroid is a list of integers, floors are exact."""
    out = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {k}))"]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS near FROM (SELECT r, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT near.c AS c, j, sum(x[j]) AS s, count(*) AS n FROM v JOIN a{i} USING (r), (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS x FROM s{i} GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, near.c::INT AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} ON c{rounds}.c = a.near.c"""


@query("op11_centroids", op11_sql())
def op11(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("checked")


@query("op12_sentencepiece")
def op12(spark, sf_dir):
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    decoded = pieces.decode_ids(encoded.select("doc_id", "ids"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
s AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM s GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1)),
valued AS (SELECT cuts.*, u.f AS l, v.f AS r, n, 1000 * a * n // (u.f * v.f) AS score FROM cuts JOIN t USING (lang) JOIN f u ON u.lang = cuts.lang AND u.phrase = x JOIN f v ON v.lang = cuts.lang AND v.phrase = y),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = c.lang AND x.m > c.m AND 100 * x.f >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
