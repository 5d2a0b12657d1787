"""Declared schemas: never inferred, checked on every boundary, and named by a digest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldloom.errors import ContractError

#: A value that is a text, a whole number of any width or a float; exactly one slot is filled.
TAGGED_SCALAR = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("string_value", T.StringType()),
        T.StructField("integer_value", T.BinaryType()),
        T.StructField("float_value", T.DoubleType()),
    ]
)
SEMANTIC_TYPES = ("identifier", "dimension", "measure", "time", "text")


def column(name: str, kind: T.DataType, nullable: bool = False, *, description: str = "", unit: str = "", semantic_type: str = "") -> T.StructField:
    if semantic_type and semantic_type not in SEMANTIC_TYPES:
        raise ContractError(f"unknown semantic type {semantic_type!r}")
    meta = {k: v for k, v in (("description", description), ("unit", unit), ("semantic_type", semantic_type)) if v}
    return T.StructField(name, kind, nullable, meta)


def schema_digest(schema: T.StructType) -> str:
    """SHA-256 of the schema's canonical JSON."""
    return hashlib.sha256(json.dumps(schema.jsonValue(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order; raises on missing, further or ill-typed ones. Adds no cast."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    if missing := [n for n in want if n not in have]:
        raise ContractError(f"missing columns: {missing}")
    if further := [n for n in have if n not in want]:
        raise ContractError(f"undeclared columns: {further}")
    if wrong := [n for n in want if have[n].simpleString() != want[n].simpleString()]:
        raise ContractError("types differ: " + ", ".join(f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in wrong))
    return df.select(*[df[f.name].alias(f.name, metadata=f.metadata) for f in schema])
