"""Canonical table schemas and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _D, _I, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in spec])


MEMORIES = _struct([
    ("entity_id", _S), ("id", _S), ("content", _S), ("summary", _S), ("memory_type", _S),
    ("internal_type", _S), ("confidence", _D), ("provenance", _S), ("validation_count", _I),
    ("validated_at", _TS), ("contradiction_detected", _B), ("is_latest", _B), ("valid_from", _TS),
    ("valid_until", _TS), ("expired_at", _TS), ("replaced_by", _S), ("source_document_id", _S),
    ("source_type", _S), ("container_tag", _S), ("tags", T.ArrayType(_S)), ("tokens_estimate", _I),
    ("access_count", _I), ("last_accessed_at", _TS), ("created_at", _TS), ("updated_at", _TS),
    ("metadata", T.MapType(_S, _S)),
])
EDGES = _struct([("entity_id", _S), ("from_id", _S), ("to_id", _S), ("rel_type", _S), ("created_at", _TS), ("props", T.MapType(_S, _S))])
MENTIONS = _struct([
    ("entity_id", _S), ("mention_id", _S), ("canonical_form", _S), ("type", _S), ("aliases", T.ArrayType(_S)),
    ("mention_count", T.LongType()), ("created_at", _TS), ("last_seen_at", _TS),
])
MENTION_EDGES = _struct([("entity_id", _S), ("memory_id", _S), ("mention_id", _S), ("surface_form", _S), ("confidence", _D), ("created_at", _TS)])
EMBEDDINGS = _struct([
    ("entity_id", _S), ("chunk_id", _S), ("document_id", _S), ("text", _S), ("embedding", T.ArrayType(T.FloatType())),
    ("model_name", _S), ("dimensions", _I),
])
FAST_LANE = _struct([
    ("entity_id", _S), ("id", _S), ("text", _S), ("embedding", T.ArrayType(T.FloatType())), ("stage", _S),
    ("created_at", _TS), ("archived_at", _TS),
])

DEFAULT_MEMORY_TYPE = "fact"
DEFAULT_CONFIDENCE = 0.8
DEFAULT_PROVENANCE = "explicit_statement"
SUMMARY_LENGTH = 200
CHARS_PER_TOKEN = 4


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
