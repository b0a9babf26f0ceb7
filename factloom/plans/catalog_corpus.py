"""Queries over the corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import corpus
from factloom.plans.registry import query
from factloom.sources import seed

WS = "E' \\n\\t\\r\\f\\x0b'"


def _docs(spark, d):
    return seed.read(spark, d, "documents")


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def sql_pack(parts: str, fits: str, joined: str) -> str:
    """Greedy packing as a reduce over {{done, buf}} structs; a and x are the two sides."""
    return f"""(SELECT CASE WHEN len(z) = 0 THEN []::varchar[] ELSE list_append(r.done, r.buf) END FROM (SELECT z, CASE WHEN len(z) = 0 THEN NULL ELSE list_reduce(z, lambda a, x:
  CASE WHEN {fits} THEN {{'done': a.done, 'buf': {joined}}} ELSE {{'done': list_append(a.done, a.buf), 'buf': x.buf}} END) END AS r
  FROM (SELECT list_transform({parts}, lambda s: {{'done': []::varchar[], 'buf': s}}) AS z)))"""


SENT = "list_filter(string_split(regexp_replace({0}, '([.!?。！？\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, " + WS + ") <> '')"
PARA = "list_filter(list_transform(string_split({0}, E'\\n\\n'), lambda p: " + _strip("p") + "), lambda p: p <> '')"


def sql_text_chunks(source: str) -> str:
    """CTEs ending in ``chunked(doc_id, source, chunks)`` for rows of ``source``."""
    return f"""para AS (SELECT doc_id, source, pi, p FROM (SELECT doc_id, source, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM (SELECT doc_id, source, {PARA.format('text')} AS ps FROM {source}))),
 pk AS (SELECT doc_id, source, pi, CASE WHEN length(p) <= 2048 THEN [p] ELSE list_transform({sql_pack(SENT.format('p'), 'length(a.buf) + length(x.buf) <= 2048', "a.buf || ' ' || x.buf")}, lambda c: {_strip('c')}) END AS cs FROM para),
 al AS (SELECT doc_id, source, flatten(list(cs ORDER BY pi)) AS cs FROM pk GROUP BY ALL),
 chunked AS (SELECT doc_id, source, {sql_pack('cs', 'length(a.buf) < 400 AND length(a.buf) + length(x.buf) <= 2048', "a.buf || E'\\n\\n' || x.buf")} AS chunks FROM al)"""


@query("t1_text_chunks", f"WITH docs AS (SELECT * FROM documents), {sql_text_chunks('docs')} SELECT doc_id, unnest(range(len(chunks)))::int AS index, unnest(chunks) AS text, unnest(list_transform(chunks, lambda c: greatest(1, length(c) // 4)::int)) AS token_count FROM chunked")
def t1(spark, d):
    """Paragraph and sentence chunks of every document."""
    return corpus.chunk_table(_docs(spark, d), corpus.text_chunks(F.col("text")), ["doc_id"])


def _split_docs(spark, d):
    """Documents with a blank line after every line end."""
    return _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("t1_merged_paragraphs", f"WITH docs AS (SELECT * REPLACE (replace(text, E'\\n', E'\\n\\n') AS text) FROM documents), {sql_text_chunks('docs')} SELECT doc_id, unnest(range(len(chunks)))::int AS index, unnest(chunks) AS text FROM chunked")
def t1m(spark, d):
    """The same where line ends are paragraphs, so short ones merge."""
    return corpus.chunk_table(_split_docs(spark, d), corpus.text_chunks(F.col("text")), ["doc_id"]).drop("token_count")


@query("t1_chunk_stats", f"WITH docs AS (SELECT * FROM documents), {sql_text_chunks('docs')}, c AS (SELECT source, unnest(chunks) AS text FROM chunked) SELECT source, count(*) AS chunks, sum(greatest(1, length(text) // 4))::bigint AS tokens, max(greatest(1, length(text) // 4))::int AS largest, (count(*) - count(DISTINCT text))::bigint AS repeated FROM c GROUP BY 1")
def t1s(spark, d):
    """Chunk statistics per source."""
    chunks = corpus.chunk_table(_docs(spark, d), corpus.text_chunks(F.col("text")), ["source", "doc_id"])
    return corpus.chunk_stats(chunks, "source").drop("median")  # an approximate percentile has no exact twin


@query("t6_paragraph_chunks", f"WITH p AS (SELECT doc_id, {PARA.format('text')} AS ps FROM (SELECT doc_id, replace(text, E'\\n', E'\\n\\n') AS text FROM documents)), c AS (SELECT doc_id, {sql_pack('ps', 'length(a.buf) + length(x.buf) <= 2048', "a.buf || E'\\n\\n' || x.buf")} AS chunks FROM p) SELECT doc_id, unnest(range(len(chunks)))::int AS index, unnest(chunks) AS text FROM c")
def t6(spark, d):
    """Paragraphs packed up to the target size."""
    return corpus.chunk_table(_split_docs(spark, d), corpus.paragraph_chunks(F.col("text")), ["doc_id"]).drop("token_count")


def _transcripts(spark, d):
    """One labelled transcript per conversation, every fourth one unlabelled."""
    c = seed.read(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "**Assistant**: ").otherwise("system : ")
    label = F.when(F.col("conv_id") % 4 == 3, "").otherwise(label)
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, F.col("text")).alias("line")))), lambda s: s["line"]), "\n").alias("text"))


@query("t2_turn_table", """WITH t AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 4 = 3 THEN '' WHEN role = 'user' THEN 'User: ' WHEN role = 'assistant' THEN '**Assistant**: ' ELSE 'system : ' END || text, E'\\n' ORDER BY turn) AS text FROM conversations GROUP BY 1),
 l AS (SELECT conv_id, list_filter(string_split(regexp_replace(text, '(?im)^(?:\\*\\*)?(User|Assistant|System|AI|Human|Bot)(?:\\*\\*)?\\s*:\\s*', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2))) AS ps FROM t)
SELECT conv_id, unnest(range(len(ps)))::int AS index, split_part(unnest(ps), chr(2), 1) AS speaker, """ + _strip("split_part(unnest(ps), chr(2), 2)") + " AS text FROM l")
def t2(spark, d):
    """Speaker turns of labelled transcripts."""
    rows = _transcripts(spark, d).select("conv_id", F.posexplode(corpus.transcript_turns(F.col("text"))).alias("index", "t"))
    return rows.select("conv_id", "index", "t.speaker", "t.text")


@query("t2_conversation_chunks", f"""WITH t AS (SELECT conv_id, string_agg(text, E'\\n' ORDER BY turn) AS text FROM conversations GROUP BY 1), s AS (SELECT conv_id, list_filter(string_split(regexp_replace(text, '([.!?。！？\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS}) <> '') AS ps FROM t),
 c AS (SELECT conv_id, {sql_pack('ps', 'length(a.buf) + 1 + length(x.buf) <= 2048', "a.buf || ' ' || x.buf")} AS chunks FROM s) SELECT conv_id, unnest(range(len(chunks)))::int AS index, {_strip('unnest(chunks)')} AS text FROM c""")
def t2c(spark, d):
    """Chunks by size where nobody is named."""
    c = seed.read(spark, d, "conversations")
    plain = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return corpus.conversation_chunks(plain, "text", ["conv_id"]).drop("token_count")


@query("t2_turn_pairs", "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def t2p(spark, d):
    """Questions with their answers."""
    return corpus.turn_pairs(seed.read(spark, d, "conversations"))


def _markdown(spark, d):
    """Documents as Markdown: line i becomes a heading of level i % 3 + 1 by turns, with one fence."""
    lines = F.transform(F.split("text", "\n"), lambda ln, i: F.concat(F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "))).otherwise(""), ln))
    fence = F.concat(F.lit("```\n# no heading "), F.col("doc_id").cast("string"), F.lit("\n```\n"))
    body = F.array_join(lines, "\n")
    return _docs(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n"), fence)).otherwise(""), body, F.lit("\n"), fence).alias("text"))


@query("t3_markdown_sections", """WITH RECURSIVE m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN E'intro\\n```\\n# no heading ' || doc_id::varchar || E'\\n```\\n' ELSE '' END
  || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN (i - 1) % 2 = 0 THEN repeat('#', ((i - 1) % 3 + 1)::int) || ' ' ELSE '' END || ls[i]), E'\\n') || E'\\n```\\n# no heading ' || doc_id::varchar || E'\\n```\\n' AS text FROM (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents)),
 seg AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(```(?s:.*?)```)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, """ + WS + """) <> '') AS ss FROM m)),
 pc AS (SELECT doc_id, si, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM (SELECT doc_id, si, list_filter(string_split(regexp_replace(""" + _strip("s") + """, '(?m)^(#{1,6}\\s+.+)$', chr(2) || '\\1', 'g'), chr(2)), lambda x: trim(x, """ + WS + """) <> '') AS ps FROM seg WHERE NOT starts_with(s, '```'))),
 hd AS (SELECT *, length(regexp_extract(p, '^(#{1,6})\\s+.', 1)) AS lv, regexp_extract(p, '^#{1,6}\\s+(.+)', 1) AS title FROM pc),
 st AS (SELECT doc_id, si, -1::bigint AS pi, []::struct(l bigint, t varchar)[] AS stack, '' AS path, '' AS text FROM (SELECT DISTINCT doc_id, si FROM hd)
   UNION ALL SELECT doc_id, si, pi, stack, CASE WHEN lv > 0 THEN array_to_string(list_transform(stack, lambda h: h.t), ' / ') ELSE '' END, """ + _strip("p") + """ FROM (
    SELECT h.doc_id, h.si, h.pi, h.lv, h.p, CASE WHEN h.lv > 0 THEN list_append(list_filter(s.stack, lambda x: x.l < h.lv), {'l': h.lv, 't': h.title}) ELSE s.stack END AS stack FROM st s JOIN hd h ON h.doc_id = s.doc_id AND h.si = s.si AND h.pi = s.pi + 1))
SELECT doc_id, path, text, false AS is_code FROM st WHERE pi >= 0 UNION ALL SELECT doc_id, '', s, true FROM seg WHERE starts_with(s, '```')""")
def t3(spark, d):
    """Markdown sections with their heading path, fences apart."""
    rows = _markdown(spark, d).select("doc_id", F.explode(corpus.markdown_sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.array_join("s.path", " / ").alias("path"), F.col("s.text").alias("text"), F.col("s.is_code").alias("is_code"))


def _csv(spark, d):
    """Each document as a CSV text of its words."""
    words = F.filter(F.split(F.regexp_replace("text", r'[",\r\n]', " "), " "), lambda w: w != "")
    rows = F.transform(words, lambda w, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(","), w))
    return _docs(spark, d).select("doc_id", F.concat(F.lit("place,word"), F.array_join(rows, "")).alias("text"))


@query("t4_csv_batches", f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[",\\r\\n]', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents), r AS (SELECT doc_id, list_filter(list_transform(range(1, len(ws) + 1), lambda i: (i - 1)::varchar || ',' || ws[i]), lambda x: true) AS rows FROM w),
 c AS (SELECT doc_id, CASE WHEN len(rows) = 0 THEN ['place,word'] ELSE list_transform({sql_pack('rows', 'length(a.buf) + length(x.buf) + 12 <= 2048', "a.buf || E'\\n' || x.buf")}, lambda b: E'place,word\\n' || b) END AS chunks FROM r)
SELECT doc_id, unnest(range(len(chunks)))::int AS index, unnest(chunks) AS text FROM c""")
def t4(spark, d):
    """T4: CSV rows packed under a repeated header."""
    return corpus.chunk_table(_csv(spark, d), corpus.csv_batches(F.col("text")), ["doc_id"]).drop("token_count")


def _json(spark, d):
    """Each document as JSON: an array of word records, or an object of two keys."""
    flat = F.regexp_replace("text", r'[^\p{L}\p{N} .]', " ")
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    items = F.transform(words, lambda w, i: F.concat(F.lit('{"w":"'), w, F.lit('","i":'), i.cast("string"), F.lit("}")))
    obj = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"text":"'), flat, F.lit('"}'))
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(obj).alias("text"))


@query("t5_json_batches", f"""WITH f AS (SELECT doc_id, regexp_replace(text, '[^\\pL\\pN .]', ' ', 'g') AS t FROM documents), w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM f WHERE doc_id % 2 = 0),
 r AS (SELECT doc_id, list_transform(range(1, len(ws) + 1), lambda i: '{{"w": "' || ws[i] || '", "i": ' || (i - 1)::varchar || '}}') AS rows FROM w),
 c AS (SELECT doc_id, list_transform({sql_pack('rows', 'length(a.buf) + length(x.buf) + 4 <= 2048', "a.buf || ', ' || x.buf")}, lambda b: '[' || b || ']') AS chunks FROM r UNION ALL SELECT doc_id, ['{{"id": ' || doc_id::varchar || '}}', '{{"text": "' || t || '"}}'] FROM f WHERE doc_id % 2 = 1)
SELECT doc_id, unnest(range(len(chunks)))::int AS index, unnest(chunks) AS text FROM c""")
def t5(spark, d):
    """T5: JSON records in bounded batches, objects per key."""
    return corpus.chunk_table(_json(spark, d), corpus.json_batches(F.col("text")), ["doc_id"]).drop("token_count")


def _code(spark, d):
    """Documents as code: sentences become blocks that start with a definition by turns."""
    blocks = F.transform(F.split("text", r"\. "), lambda s, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("def f"), i.cast("string"), F.lit("(x):\n  "))).when(i % 3 == 1, F.concat(F.lit("class K"), i.cast("string"), F.lit(":\n  "))).otherwise(""), F.regexp_replace(s, r"\s+", " ")))
    return _docs(spark, d).select("doc_id", F.concat(F.lit("\n"), F.array_join(blocks, "\r\n\n\n\n")).alias("text"))


@query("t7_t12_code_blocks", """WITH b AS (SELECT doc_id, string_split(text, '. ') AS ss FROM documents), x AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM b),
 y AS (SELECT doc_id, i, regexp_replace(regexp_replace(CASE i % 3 WHEN 0 THEN 'def f' || i::varchar || E'(x):\\n  ' WHEN 1 THEN 'class K' || i::varchar || E':\\n  ' ELSE '' END || regexp_replace(s, '\\s+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS text FROM x)
SELECT doc_id, text, CASE i % 3 WHEN 0 THEN 'f' || i::varchar WHEN 1 THEN 'K' || i::varchar ELSE 'module' END AS name, (length(text) - length(replace(text, E'\\n', '')) + 1)::int AS lines, 'python' AS language FROM y WHERE text <> ''""")
def t7(spark, d):
    """Cleaned code in blocks with name and language."""
    docs = _code(spark, d).select("doc_id", corpus.clean_code(F.col("text")).alias("text"))
    return corpus.code_table(docs, "text", ["doc_id"])


def _sql_mask(text: str) -> str:
    for kind, pattern in X.PII_PATTERNS:
        text = f"regexp_replace({text}, '{pattern}', '[{kind}]', 'g')"
    return text


@query("t8_x18_masked_text", f"SELECT doc_id, {_sql_mask('text')} AS masked FROM documents")
def t8(spark, d):
    """Texts with personal data masked."""
    return corpus.masked(_docs(spark, d), "text").select("doc_id", "masked")


KINDS = list(dict.fromkeys(k for k, _ in X.PII_PATTERNS))


@query("t8_pii_report", f"WITH m AS (SELECT source, text, {_sql_mask('text')} AS masked FROM documents), h AS (" + " UNION ALL ".join(
    f"SELECT source, '{k}' AS kind, (length(masked) - length(replace(masked, '[{k}]', ''))) // {len(k) + 2} - (length(text) - length(replace(text, '[{k}]', ''))) // {len(k) + 2} AS n FROM m" for k in KINDS)
    + ") SELECT source, kind, sum(n)::bigint AS hits, count(*) AS texts FROM h WHERE n > 0 GROUP BY ALL")
def t8r(spark, d):
    """Hits by source and kind."""
    return corpus.pii_report(_docs(spark, d), "text", "source")


def _sql_page(html: str = "html") -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({html}, '(?i)<script[^>]*>(?s:.*?)</script>', ' ', 'g'), '(?i)<style[^>]*>(?s:.*?)</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("t9_page_text", f"""SELECT page_id, {_sql_page()} AS text, trim(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']+)["'']', 1), ''), regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1))) AS title,
 trim(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:description["''][^>]+content=["'']([^"'']+)["'']', 1), ''), regexp_extract(html, '(?i)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']+)["'']', 1))) AS description,
 trim(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:image["''][^>]+content=["'']([^"'']+)["'']', 1)) AS image, trim(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:site_name["''][^>]+content=["'']([^"'']+)["'']', 1)) AS site_name,
 CASE WHEN icon LIKE '//%' THEN 'https:' || icon WHEN icon LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || icon ELSE icon END AS favicon,
 regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM (SELECT *, trim(regexp_extract(html, '(?i)<link[^>]+rel=["''](?:shortcut )?icon["''][^>]+href=["'']([^"'']+)["'']', 1)) AS icon FROM pages)""")
def t9(spark, d):
    """Text and metadata of stored pages."""
    return corpus.page_metadata(seed.read(spark, d, "pages")).select("page_id", "text", "title", "description", "image", "site_name", "favicon", "host")


@query("t9_host_counts", f"SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, count(*) AS pages, sum(length({_sql_page()}))::bigint AS chars FROM pages GROUP BY 1")
def t9h(spark, d):
    """Pages and text size per host."""
    return corpus.page_metadata(seed.read(spark, d, "pages")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))


@query("t10_fast_lane_split", f"""WITH RECURSIVE p AS (SELECT doc_id, text FROM documents), q AS (SELECT doc_id, unnest(ps) AS part, unnest(range(len(ps))) AS pi FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM p)),
 r AS (SELECT doc_id, pi, 0 AS n, '' AS piece, part AS rest FROM q UNION ALL
  SELECT doc_id, pi, n + 1, CASE WHEN length(rest) <= 1024 THEN rest ELSE {_strip('substr(rest, 1, cutoff)')} END, CASE WHEN length(rest) <= 1024 THEN '' ELSE {_strip('substr(rest, cutoff + 1)')} END FROM (
   SELECT *, CASE WHEN z1 >= 512 AND z1 < 1024 THEN z1 WHEN z2 >= 512 AND z2 < 1024 THEN z2 ELSE 1024 END AS cutoff FROM (SELECT *, CASE WHEN contains(h, '。') THEN 1024 - instr(reverse(h), '。') ELSE -1 END AS z1, CASE WHEN contains(h, '.') THEN 1024 - instr(reverse(h), '.') ELSE -1 END AS z2 FROM (SELECT *, substr(rest, 1, 1024) AS h FROM r WHERE rest <> ''))))
SELECT doc_id, piece AS text FROM r WHERE n > 0 AND piece <> ''""")
def t10(spark, d):
    """Coarse pieces for the fast lane."""
    return _docs(spark, d).select("doc_id", F.explode(corpus.fast_lane_pieces(F.col("text"))).alias("text"))


@query("a10_distinct_embedding", f"SELECT doc_id, array_to_string(list_transform({seed.sql_hash_embedding('text', 16)}, lambda x: round(x::double * 1000000)::bigint::varchar), ',') AS v FROM documents")
def a10(spark, d):
    """A10: each distinct text embedded once and joined back."""
    from factloom.operators.embed import embed_distinct
    out = embed_distinct(_docs(spark, d), "text", lambda c: X.hash_embedding(c, 16))
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string")), ",").alias("v"))
