"""Memory-model tables derived from the driver tables by plain arithmetic.

Every rule is a function of ``doc_id`` (or turn, event, item) alone, so the
same rows can be rebuilt in SQL by the oracle, and their number grows with the
source table. ``SQL_*`` strings are that independent SQL form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.session import spread

NOW = "2024-02-01 00:00:00"
DIMS = 32

MEMORY_KINDS = ["fact", "fact", "preference", "episodic", "episodic", "observation"]
PROVENANCES = ["explicit_statement", "validated", "observed", "corrected", "imported", "inferred", "hearsay"]
INTERNALS = ["decision", "goal", "preference", "error", "context", None, None, None]
TAGS = ["default", "work", "home", None]
GAZETTEER = [
    ("the", "The", "concept"), ("und", "Und", "concept"), ("que", "Que", "person"), ("with", "With", "technology"),
    ("pour", "Pour", "organization"), ("nicht", "Nicht", "role"), ("para", "Para", "location"), ("that", "That", "concept"),
    ("these", "The", "concept"), ("einer", "Und", "concept"),
]
CITIES = ["北京", "上海", "深圳", "杭州", "伦敦"]
FIRMS = ["Google", "Stripe", "Apple", "腾讯", "Meta"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def _pick(index: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, F.lit(value)).otherwise(out)
    return out


def _sql_pick(index: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def memories(documents: DataFrame) -> DataFrame:
    """One memory per document, whole text, source as the entity."""
    n = F.col("doc_id")
    k = F.floor(n / 20)
    now = X.at(NOW)
    created = now - _minutes((n * 7919) % 172800)
    return documents.select(
        F.col("source").alias("entity_id"),
        F.concat(F.lit("m"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.col("text").alias("content"),
        F.substring("text", 1, 200).alias("summary"),
        _pick(k % 6, MEMORY_KINDS).alias("memory_type"),
        _pick(k % 8, INTERNALS).alias("internal_type"),
        (((k * 37 + n) % 100) / F.lit(100.0)).alias("confidence"),
        _pick(k % 7, PROVENANCES).alias("provenance"),
        (k % 5).cast("int").alias("validation_count"),
        F.lit(None).cast("timestamp").alias("validated_at"),
        (k % 13 == 0).alias("contradiction_detected"),
        (k % 9 != 0).alias("is_latest"),
        created.alias("valid_from"),
        F.when(k % 11 == 0, now - F.expr("INTERVAL '2' DAY"))
        .when(k % 11 == 1, now + F.expr("INTERVAL '5' DAY"))
        .when(k % 11 == 2, now).alias("valid_until"),
        F.lit(None).cast("timestamp").alias("expired_at"),
        F.lit(None).cast("string").alias("replaced_by"),
        F.concat(F.lit("d"), n.cast("string")).alias("source_document_id"),
        F.lit("document").alias("source_type"),
        _pick(k % 4, TAGS).alias("container_tag"),
        F.array(F.concat(F.lit("lang:"), F.col("lang"))).alias("tags"),
        F.floor(F.length("text") / 4).cast("int").alias("tokens_estimate"),
        (n % 50).cast("int").alias("access_count"),
        F.when(k % 3 == 0, created + F.expr("INTERVAL '36' HOUR")).alias("last_accessed_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )


SQL_MEM = f"""SELECT source AS entity_id, 'm' || lpad(doc_id::varchar, 12, '0') AS id, text AS content,
  substr(text, 1, 200) AS summary,
  {_sql_pick('(doc_id // 20) % 6', MEMORY_KINDS)} AS memory_type,
  {_sql_pick('(doc_id // 20) % 8', INTERNALS)} AS internal_type,
  (((doc_id // 20) * 37 + doc_id) % 100) / 100.0::double AS confidence,
  {_sql_pick('(doc_id // 20) % 7', PROVENANCES)} AS provenance,
  ((doc_id // 20) % 5)::int AS validation_count,
  (doc_id // 20) % 13 = 0 AS contradiction_detected,
  (doc_id // 20) % 9 <> 0 AS is_latest,
  CASE (doc_id // 20) % 11 WHEN 0 THEN timestamp '2024-01-30' WHEN 1 THEN timestamp '2024-02-06'
    WHEN 2 THEN timestamp '2024-02-01' END AS valid_until,
  {_sql_pick('(doc_id // 20) % 4', TAGS)} AS container_tag,
  (doc_id % 50)::int AS access_count,
  CASE WHEN (doc_id // 20) % 3 = 0 THEN timestamp '2024-02-01' - to_minutes((doc_id * 7919) % 172800) + interval 36 hour END AS last_accessed_at,
  timestamp '2024-02-01' - to_minutes((doc_id * 7919) % 172800) AS created_at,
  lang, doc_id FROM documents"""


def statements(documents: DataFrame) -> DataFrame:
    """Short dated facts per source, cycling through the relation rules.

    Two rows in eight keep the document's own text, the others state a value
    chosen by ``doc_id``, so that updates, extensions and completions occur.
    """
    n = F.col("doc_id")
    k = F.floor(n / 20)
    now = X.at(NOW)
    word = F.regexp_extract("text", r"^[A-Za-z]+", 0)
    content = (
        F.when(k % 8 == 0, F.concat(F.lit("用户住在"), _pick(F.floor(n / 7) % 5, CITIES)))
        .when(k % 8 == 1, F.concat(F.lit("用户在 "), _pick(F.floor(n / 11) % 5, FIRMS), F.lit(" 工作")))
        .when(k % 8 == 2, F.concat(F.lit("项目预算是 "), (n % 9 + 10).cast("string"), F.lit(" 万")))
        .when(k % 8 == 3, F.concat(F.lit("明天有考试"), (n % 3).cast("string")))
        .when(k % 8 == 4, F.concat(F.lit("考试"), (n % 3).cast("string"), F.lit("结束")))
        .when(k % 8 == 5, F.concat(F.lit("用户不喜欢 "), word))
        .otherwise(F.col("text"))
    )
    created = now - _minutes((n * 7919) % 172800)
    return documents.select(
        F.col("source").alias("entity_id"),
        F.concat(F.lit("s"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        content.alias("content"),
        _pick(k % 6, MEMORY_KINDS).alias("memory_type"),
        _pick(k % 8, INTERNALS).alias("internal_type"),
        (((k * 37 + n) % 100) / F.lit(100.0)).alias("confidence"),
        F.when(k % 11 == 0, now - F.expr("INTERVAL '2' DAY")).alias("valid_until"),
        F.lit(True).alias("is_latest"),
        created.alias("created_at"),
    )


SQL_STMT = f"""SELECT source AS entity_id, 's' || lpad(doc_id::varchar, 12, '0') AS id,
  CASE (doc_id // 20) % 8
    WHEN 0 THEN '用户住在' || {_sql_pick('(doc_id // 7) % 5', CITIES)}
    WHEN 1 THEN '用户在 ' || {_sql_pick('(doc_id // 11) % 5', FIRMS)} || ' 工作'
    WHEN 2 THEN '项目预算是 ' || (doc_id % 9 + 10)::varchar || ' 万'
    WHEN 3 THEN '明天有考试' || (doc_id % 3)::varchar
    WHEN 4 THEN '考试' || (doc_id % 3)::varchar || '结束'
    WHEN 5 THEN '用户不喜欢 ' || regexp_extract(text, '^[A-Za-z]+')
    ELSE text END AS content,
  {_sql_pick('(doc_id // 20) % 6', MEMORY_KINDS)} AS memory_type,
  {_sql_pick('(doc_id // 20) % 8', INTERNALS)} AS internal_type,
  (((doc_id // 20) * 37 + doc_id) % 100) / 100.0::double AS confidence,
  CASE WHEN (doc_id // 20) % 11 = 0 THEN timestamp '2024-01-30' END AS valid_until,
  timestamp '2024-02-01' - to_minutes((doc_id * 7919) % 172800) AS created_at
  FROM documents"""


def edges(documents: DataFrame) -> DataFrame:
    """Edges between documents of one source that lie 20, 60 or 100 ids apart."""
    n = F.col("doc_id")
    k = F.floor(n / 20)
    steps = F.explode(F.array(F.lit(20), F.lit(60), F.lit(100))).alias("step")
    new = documents.select(F.col("source").alias("entity_id"), n.alias("a"), k.alias("k"), steps)
    new = new.withColumn("b", F.col("a") - F.col("step")).filter((F.col("k") + F.col("step")) % 7 < 3)
    old = documents.select(F.col("source").alias("entity_id"), n.alias("b"))
    mid = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 12, "0"))
    return new.join(old, ["entity_id", "b"]).select(
        "entity_id", mid("a").alias("from_id"), mid("b").alias("to_id"),
        _pick((F.col("k") + F.col("step")) % 7, ["UPDATES", "EXTENDS", "DERIVES_FROM"]).alias("rel_type"),
        (X.at(NOW) - _minutes((F.col("a") * 7919) % 172800)).alias("created_at"),
        F.create_map(F.lit("conflict_id"), F.concat(F.lit("k"), F.col("a").cast("string"), F.lit("-"), F.col("step").cast("string"))).alias("props"),
    )


SQL_EDGE = """SELECT n.source AS entity_id, 'm' || lpad(n.doc_id::varchar, 12, '0') AS from_id,
  'm' || lpad(o.doc_id::varchar, 12, '0') AS to_id,
  CASE (n.doc_id // 20 + s.step) % 7 WHEN 0 THEN 'UPDATES' WHEN 1 THEN 'EXTENDS' ELSE 'DERIVES_FROM' END AS rel_type,
  timestamp '2024-02-01' - to_minutes((n.doc_id * 7919) % 172800) AS created_at,
  'k' || n.doc_id::varchar || '-' || s.step::varchar AS conflict_id
  FROM documents n, (SELECT unnest([20, 60, 100]) AS step) s, documents o
  WHERE o.doc_id = n.doc_id - s.step AND o.source = n.source AND (n.doc_id // 20 + s.step) % 7 < 3"""


def queries(benchmark: DataFrame) -> DataFrame:
    """One retrieval query per benchmark passage, spread over 20 sources."""
    n = F.col("item_id")
    return benchmark.select(
        F.concat(F.lit("q"), F.lpad(n.cast("string"), 6, "0")).alias("query_id"),
        F.concat(F.lit("src"), (n % 20).cast("string")).alias("entity_id"),
        F.col("text").alias("q"),
        F.when(n % 3 == 0, F.lit(5)).when(n % 3 == 1, F.lit(150)).alias("top_k"),
    )


SQL_QUERY = """SELECT 'q' || lpad(item_id::varchar, 6, '0') AS query_id, 'src' || (item_id % 20)::varchar AS entity_id,
  text AS q, least(coalesce(CASE item_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 150 END, 30), 100) AS k FROM benchmark"""


def embeddings(documents: DataFrame, dims: int = DIMS) -> DataFrame:
    """Memory vectors by text hash; every fourth one belongs to a document chunk."""
    n = F.col("doc_id")
    k = F.floor(n / 20)
    rag = k % 4 == 3
    mid = F.lpad(n.cast("string"), 12, "0")
    return documents.select(
        F.col("source").alias("entity_id"),
        F.when(rag, F.concat(F.lit("d"), n.cast("string"), F.lit(":rag:0"))).otherwise(F.concat(F.lit("m"), mid)).alias("chunk_id"),
        F.when(rag, F.concat(F.lit("d"), n.cast("string"))).alias("document_id"),
        "text",
        X.hash_embedding(F.col("text"), dims).alias("embedding"),
    )


def sql_hash_embedding(text: str, dims: int = DIMS) -> str:
    """SQL form of the hash embedding, as an array of single-precision floats."""
    return (
        f"list_transform(range(0, {dims}), lambda i: (('0x' || substr(sha256({text}), ((2*i)%32)*2+1, 4))::int / 65535.0::double * 2.0 - 1.0)::float)"
    )


def sql_cosine(a: str, b: str) -> str:
    """SQL cosine in double precision; 0 where a norm is 0."""
    return f"coalesce(list_cosine_similarity({a}::double[], {b}::double[]), 0.0)"


SQL_EMB = f"""SELECT source AS entity_id,
  CASE WHEN (doc_id // 20) % 4 = 3 THEN 'd' || doc_id::varchar || ':rag:0' ELSE 'm' || lpad(doc_id::varchar, 12, '0') END AS chunk_id,
  CASE WHEN (doc_id // 20) % 4 = 3 THEN 'd' || doc_id::varchar END AS document_id, text,
  {sql_hash_embedding('text')} AS embedding FROM documents"""


def fast_lane(conversations: DataFrame, dims: int = DIMS) -> DataFrame:
    """Raw turns as fast-lane rows of 20 sources, up to 48 hours old."""
    c, t = F.col("conv_id"), F.col("turn")
    return conversations.select(
        F.concat(F.lit("src"), (c % 20).cast("string")).alias("entity_id"),
        F.concat(F.lit("f"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id"),
        "text",
        X.hash_embedding(F.col("text"), dims).alias("embedding"),
        F.when((c + t) % 5 == 0, F.lit("indexed")).otherwise(F.lit("fast_lane")).alias("stage"),
        (X.at(NOW) - _minutes((c * 37 + t * 601) % 2880)).alias("created_at"),
        F.lit(None).cast("timestamp").alias("archived_at"),
    )


SQL_FAST = f"""SELECT 'src' || (conv_id % 20)::varchar AS entity_id, 'f' || conv_id::varchar || '-' || turn::varchar AS id, text,
  {sql_hash_embedding('text')} AS embedding,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 'indexed' ELSE 'fast_lane' END AS stage,
  timestamp '2024-02-01' - to_minutes((conv_id * 37 + turn * 601) % 2880) AS created_at FROM conversations"""


def changes(documents: DataFrame) -> DataFrame:
    """A change table touching every third document's memory."""
    n = F.col("doc_id")
    return documents.filter(n % 3 == 0).select(
        F.col("source").alias("entity_id"),
        F.concat(F.lit("m"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.when(n % 2 == 0, F.concat(F.lit("edited "), F.col("text"))).alias("content"),
        F.when(n % 5 == 0, F.lit(0.55)).alias("confidence"),
        F.when(n % 7 == 0, F.lit("observation")).alias("memory_type"),
        F.when(n % 4 == 0, F.lit(2)).alias("validations"),
        F.when(n % 11 == 0, F.lit(True)).alias("contradiction_detected"),
        F.when(n % 13 == 0, F.lit(False)).alias("is_latest"),
    )


def gazetteer(spark: SparkSession) -> DataFrame:
    rows = [(i, key, canonical, kind) for i, (key, canonical, kind) in enumerate(GAZETTEER)]
    return spark.createDataFrame(rows, "ord int, key string, canonical string, type string")


SQL_GAZ = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', '{c}', '{t}')" for i, (k, c, t) in enumerate(GAZETTEER)
) + ") g(ord, key, canonical, type)"
