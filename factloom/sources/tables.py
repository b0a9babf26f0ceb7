"""Table loads, chunk replacement, memory build, change application, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import exprs as X

# File suffix to MIME type; anything else is a byte stream.
MIME_BY_SUFFIX = {
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "csv": "text/csv",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
}
# Content types the pipeline knows by name.
PIPELINE_TYPES = ["text", "code", "markdown", "pdf", "conversation", "json", "csv", "url", "image", "audio", "video"]
# Accepted public and internal types of an extracted fact.
FACT_TYPES = ["fact", "preference", "episodic"]
INTERNAL_TYPES = [
    "decision", "commitment", "goal", "instruction", "learning", "error", "observation", "relationship", "context", "artifact",
]
# Column names under which a hub may deliver each item field.
ITEM_FIELDS = {
    "source_id": ["id", "doc_id", "file_id", "page_id", "item_id"],
    "title": ["title", "name"],
    "content": ["content", "text", "body", "plain_text"],
    "etag": ["etag", "updated_at", "version"],
}


def load(spark: SparkSession, path: str, content_type: str, schema: str | None = None) -> DataFrame:
    """Read a table by content type; text files keep one row per file."""
    reader = spark.read.schema(schema) if schema else spark.read
    if content_type == "parquet":
        return reader.parquet(path)
    if content_type == "json":
        return reader.option("multiLine", True).json(path)
    if content_type == "csv":
        return reader.option("header", True).csv(path)
    if content_type in ("text", "markdown", "code"):
        return spark.read.text(path, wholetext=True)
    raise ValueError(f"unsupported content type {content_type}")


def mime_type(filename: Column) -> Column:
    suffix = F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1)))
    out = F.lit("application/octet-stream")
    for key, value in MIME_BY_SUFFIX.items():
        out = F.when(suffix == key, F.lit(value)).otherwise(out)
    return out


def pipeline_type(mime: Column) -> Column:
    """Known suffix, else the group of text, image, audio and video, else the suffix."""
    prefix, suffix = F.substring_index(mime, "/", 1), F.regexp_extract(mime, r"(?s)^[^/]*/(.*)$", 1)
    return (
        F.when(~mime.contains("/"), mime)
        .when(suffix.isin(PIPELINE_TYPES), suffix)
        .when(prefix.isin("text", "image", "audio", "video"), prefix)
        .otherwise(suffix)
    )


def replace_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace all chunks of every incoming document; other rows stay.

    ``incoming`` has ``document_id``, ``position`` and the stored columns but
    for ``chunk_id``, which is derived from document and position.
    """
    fresh = incoming.withColumn("chunk_id", F.concat_ws(":", "document_id", F.lit("rag"), F.col("position").cast("string"))).drop("position")
    kept = stored.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh)


def content_type_of(text: Column) -> Column:
    """json, csv or text, judged from the text alone."""
    body = F.trim(F.regexp_replace(text, r"\A(?U:\s+)|(?U:\s+)\z", ""))
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda ln: F.trim(ln) != "")
    is_json = body.rlike(r"\A[\[{]") & F.try_parse_json(body).isNotNull()

    def uniform(delim: str) -> Column:
        counts = F.array_distinct(F.transform(lines, lambda ln: F.size(F.split(ln, delim))))
        return (F.size(counts) == 1) & (F.element_at(counts, 1) != 1)

    csv = (F.size(lines) >= 2) & (uniform(",") | uniform(";") | uniform("\t"))
    return F.when(body == "", "text").when(is_json, "json").when(csv, "csv").otherwise("text")


def build_memories(chunks: DataFrame, now, keep_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memory rows from chunk rows, and the rows that could not become one.

    Precedence per field: argument column ``arg_x``, then ``metadata['x']``,
    then the chunk's own column, then the default. A row without entity or
    text goes to the error frame and stops nobody else. With ``keep_blank``
    a text of nothing but spaces is a text, and only a null one is missing.
    """
    has = set(chunks.columns)

    def pick(field: str, dtype: str, default=None) -> Column:
        options = []
        if f"arg_{field}" in has:
            options.append(F.col(f"arg_{field}").cast(dtype))
        if "metadata" in has:
            options.append(F.col("metadata")[field].try_cast(dtype))
        if field in has:
            options.append(F.col(field).cast(dtype))
        return F.coalesce(*options, F.lit(default).cast(dtype))

    no_text = F.col("text").isNull() if keep_blank else F.trim(F.coalesce("text", F.lit(""))) == ""
    problem = F.when(F.trim(F.coalesce("entity_id", F.lit(""))) == "", "missing entity").when(no_text, "empty content")
    marked = chunks.withColumn("_problem", problem)
    moment = X.at(now)
    created = F.coalesce(F.col("created_at"), moment) if "created_at" in has else moment
    good = marked.filter(F.col("_problem").isNull()).select(
        "entity_id",
        F.sha2(F.concat_ws("\x1f", "entity_id", "document_id", F.col("index").cast("string")), 256).alias("id"),
        F.col("text").alias("content"),
        F.coalesce(pick("summary", "string"), F.substring("text", 1, S.SUMMARY_LENGTH)).alias("summary"),
        pick("memory_type", "string", S.DEFAULT_MEMORY_TYPE).alias("memory_type"),
        pick("internal_type", "string").alias("internal_type"),
        pick("confidence", "double", S.DEFAULT_CONFIDENCE).alias("confidence"),
        pick("provenance", "string", S.DEFAULT_PROVENANCE).alias("provenance"),
        F.lit(0).alias("validation_count"),
        F.lit(None).cast("timestamp").alias("validated_at"),
        F.lit(False).alias("contradiction_detected"),
        F.lit(True).alias("is_latest"),
        created.alias("valid_from"),
        pick("valid_until", "timestamp").alias("valid_until"),
        F.lit(None).cast("timestamp").alias("expired_at"),
        F.lit(None).cast("string").alias("replaced_by"),
        F.col("document_id").alias("source_document_id"),
        pick("source_type", "string").alias("source_type"),
        pick("container_tag", "string").alias("container_tag"),
        F.array().cast("array<string>").alias("tags"),
        F.floor(F.length("text") / S.CHARS_PER_TOKEN).cast("int").alias("tokens_estimate"),
        F.lit(0).alias("access_count"),
        F.lit(None).cast("timestamp").alias("last_accessed_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (F.col("metadata") if "metadata" in has else F.lit(None).cast("map<string,string>")).alias("metadata"),
    )
    errors = marked.filter(F.col("_problem").isNotNull()).select("entity_id", "document_id", "index", F.col("_problem").alias("error"))
    return good, errors


def apply_changes(memories: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Apply at most one change row per memory; null means leave as it is.

    ``validations`` adds to the count, ``clear_container_tag`` removes a memory
    from its space.
    """
    given = set(changes.columns) - {"entity_id", "id"}
    side = changes.select("entity_id", "id", *[F.col(c).alias(f"_c_{c}") for c in given]).withColumn("_hit", F.lit(True))
    joined = memories.join(side, ["entity_id", "id"], "left")
    out = []
    for name in memories.columns:
        current = F.col(name)
        if name == "validation_count" and "validations" in given:
            current = (F.coalesce(current, F.lit(0)) + F.coalesce("_c_validations", F.lit(0))).cast("int")
        elif name == "validated_at" and "validations" in given:
            current = F.when(F.col("_c_validations") > 0, X.at(now)).otherwise(current)
        elif name == "updated_at":
            current = F.when(F.col("_hit"), X.at(now)).otherwise(current)
        elif name in given:
            current = F.coalesce(F.col(f"_c_{name}"), current)
        if name == "container_tag" and "clear_container_tag" in given:
            current = F.when(F.coalesce("_c_clear_container_tag", F.lit(False)), F.lit(None)).otherwise(current)
        out.append(current.alias(name))
    return joined.select(*out)


def normalise_items(raw: DataFrame, default_content_type: str = "text") -> DataFrame:
    """Bring hub items of varied shape to one shape; no identity gives null id."""
    has = set(raw.columns)

    def first(field: str) -> list[Column]:
        return [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ITEM_FIELDS[field] if c in has]

    def choose(options: list[Column], default: Column) -> Column:
        return F.coalesce(*options, default)

    none = F.lit(None).cast("string")
    source_id = choose(first("source_id"), none)
    content_type = [F.nullif(F.col("content_type"), F.lit(""))] if "content_type" in has else []
    return raw.select(
        "account_id",
        source_id.alias("source_id"),
        choose(first("title"), source_id).alias("title"),
        choose(first("content"), F.lit("")).alias("content"),
        choose(content_type, F.lit(default_content_type)).alias("content_type"),
        choose(first("etag"), none).alias("etag"),
        (F.col("position") if "position" in has else F.lit(0)).cast("bigint").alias("position"),
    )


def sync_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Every delivery with its version and outcome, in the order of ``position``.

    The version is the etag, or the id itself where the hub sends none. A
    delivery is skipped if its item has no identity or was last ingested in
    that version, so v1, v2, v1 is ingested three times. An item without
    content is a failed fetch and is not remembered.
    """
    known = seen.groupBy("account_id", "source_id").agg(F.max("etag").alias("_seen"))
    rows = items.withColumn("version", F.coalesce("etag", "source_id")).join(known, ["account_id", "source_id"], "left")
    earlier = Window.partitionBy("account_id", "source_id").orderBy("position", "version", "content").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("content") != "", F.col("version")), ignorenulls=True).over(earlier)
    old = F.col("source_id").isNull() | F.coalesce(F.coalesce("_last", "_seen") == F.col("version"), F.lit(False))
    # Items without identity are skipped alone and need no window.
    named = rows.filter(F.col("source_id").isNotNull()).withColumn("_last", last)
    rows = named.unionByName(rows.filter(F.col("source_id").isNull()).withColumn("_last", F.lit(None).cast("string")))
    return rows.select(
        "account_id", "source_id", "version", "title", "content", "content_type", "position",
        F.when(old, "skipped").when(F.col("content") == "", "failed").otherwise("ingested").alias("outcome"),
    )


def updated_seen(seen: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The seen table after a sync: an item's last ingested version replaces the old one."""
    fresh = outcomes.filter("outcome = 'ingested'").groupBy("account_id", "source_id").agg(F.max_by("version", F.struct("position", "version")).alias("etag"))
    return seen.join(fresh.select("account_id", "source_id"), ["account_id", "source_id"], "left_anti").unionByName(fresh)


def sync_report(outcomes: DataFrame) -> DataFrame:
    """Counts per account and its first five failures, in order of delivery."""
    counts = outcomes.groupBy("account_id").agg(*[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("ingested", "skipped", "failed")])
    order = Window.partitionBy("account_id").orderBy("position", "source_id")
    failures = (
        outcomes.filter("outcome = 'failed'").withColumn("_r", F.row_number().over(order)).filter("_r <= 5")
        .groupBy("account_id")
        .agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("_r", "source_id"))), lambda s: F.concat(s["source_id"], F.lit(": empty content")))).alias("errors"))
    )
    return counts.join(failures, "account_id", "left")


# Account events that set the state of a binding.
ACTIVE_EVENTS = ["account.connected", "account.reconnected", "connection.created", "connection.updated"]
REVOKED_EVENTS = ["account.revoked", "account.disconnected", "connection.deleted"]


def binding_states(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """(account_id, status) of the bindings whose state the events set, by the last one."""
    state = F.when(F.col("event_type").isin(ACTIVE_EVENTS), "active").when(F.col("event_type").isin(REVOKED_EVENTS), "revoked")
    known = events.join(bindings.select("account_id").distinct(), "account_id", "left_semi")
    return known.withColumn("_state", state).filter(F.col("_state").isNotNull()).groupBy("account_id").agg(F.max_by("_state", F.struct("position", "_state")).alias("status"))


def event_items(events: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that lead to ingestion, and those of unknown accounts.

    A revoking event ends there; every other event of a bound account, a
    connecting one included, syncs it.
    """
    known = bindings.select("account_id").distinct()
    content = events.filter(~F.coalesce(F.col("event_type").isin(REVOKED_EVENTS), F.lit(False)))
    return content.join(known, "account_id", "left_semi"), events.join(known, "account_id", "left_anti")


def resolve_events(events: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Account events with the entity of the account's first binding; the rest apart."""
    first = bindings.groupBy("account_id").agg(F.min_by("entity_id", F.struct("created_at", "binding_id")).alias("entity_id"))
    joined = events.join(first, "account_id", "left")
    return joined.filter(F.col("entity_id").isNotNull()), joined.filter(F.col("entity_id").isNull()).drop("entity_id")


def valid_facts(facts: DataFrame, keys: list[str], order: list[str], max_facts: int | None = None) -> DataFrame:
    """Validate extracted facts: first of equal normalised texts, types, clamps."""
    text = F.trim(F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", ""))
    rows = facts.withColumn("text", text).filter(F.col("text") != "")
    rows = rows.withColumn("_key", F.lower(F.regexp_replace("text", r"(?U)\s+", " ")))
    first = F.row_number().over(Window.partitionBy(*keys, "_key").orderBy(*order))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n", "_key")
    kind = F.lower("type")
    internal = F.trim(F.lower("internal_type"))
    rows = rows.withColumns({
        "memory_type": F.when(kind.isin(FACT_TYPES), kind).otherwise("fact"),
        "internal_type": F.when(internal.isin(INTERNAL_TYPES), internal),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8)))),
        "summary": F.substring(F.coalesce("summary", F.lit("")), 1, 200),
    }).drop("type")
    if max_facts is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= max_facts).drop("_n")
