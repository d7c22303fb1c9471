"""Row layouts of requests and results."""

from __future__ import annotations

import json

from pyspark.sql import types as T

REQUEST = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "input_data", "query", "schema_model")])

SAMPLE = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("ord", T.LongType()), T.StructField("content", T.StringType()), T.StructField("is_content_url", T.BooleanType()), T.StructField("query", T.StringType()), T.StructField("schema_model", T.StringType()), T.StructField("status", T.StringType())]
)

RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "prediction", "xpaths", "status", "error")])

PENDING, SUCCESS, FAILED = "pending", "success", "failed"


def schema_text(schema) -> str | None:
    """A schema as text: strings as they are, mappings as JSON, model classes as their JSON Schema."""
    if schema is None or isinstance(schema, str):
        return schema
    if hasattr(schema, "model_json_schema"):
        return json.dumps(schema.model_json_schema())
    return json.dumps(schema)
