"""Rows from stored JSON responses: one body a file, read with a declared schema, in the order of the body."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.checks import none_where
from fieldloom.errors import ContractError
from fieldloom.schema import TAGGED_SCALAR

ORDINAL = "source_ordinal"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def as_sent(kind: T.DataType, odd: Mapping[str, str]) -> T.DataType:
    """The type under the names of the responses: camel case, but for the names listed in `odd`."""
    if kind == TAGGED_SCALAR:
        return T.VariantType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(odd.get(f.name, camel(f.name)), as_sent(f.dataType, odd)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(as_sent(kind.elementType, odd))
    return kind


def tagged(v: Column) -> Column:
    """A variant that is a text or a number as a tagged scalar; whole numbers as their shortest big-endian two's complement."""
    kind = F.schema_of_variant(v)
    whole, text = kind.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$"), kind == "STRING"
    n = F.variant_get(v, "$", "bigint")
    digits = F.hex(n)
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    plus = F.when(even.rlike("^[89A-F]"), F.concat(F.lit("00"), even)).otherwise(even)
    least = F.unhex(F.when(n < 0, F.regexp_replace(digits, "^(FF)+(?=[89A-F])", "")).otherwise(plus))
    tag = F.when(text, "string").when(whole, "integer").when(kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL\(.*)$"), "float")
    of = F.struct(
        F.coalesce(tag, F.raise_error(F.lit("contract: a value is neither text nor number"))).alias("kind"),
        F.when(text, F.variant_get(v, "$", "string")).alias("string_value"),
        F.when(whole, least).alias("integer_value"),
        F.when(~text & ~whole, F.variant_get(v, "$", "double")).alias("float_value"),
    )
    return F.when(v.isNotNull(), of)


def read_pages(spark: SparkSession, path: str, schema: T.StructType, *, shape: str = "list", odd: Mapping[str, str] | None = None) -> DataFrame:
    """The declared columns, and source_ordinal: the place in the body. Bodies are read one a row and exploded on executors.

    shape: 'list' (an array of objects), 'object' (one row) or 'scalars' (an array of values, for a schema of one
    column). Bodies that aren't JSON of that shape raise when read, as do fields the schema doesn't declare and nulls
    in columns that it declares without. An empty array gives no rows.
    """
    sent = as_sent(schema, odd or {})
    item = sent[0].dataType if shape == "scalars" else sent
    whole = {"list": T.ArrayType(sent), "scalars": T.ArrayType(item), "object": sent}[shape]
    body = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", whole, {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"})
    if shape == "object":
        rows = body.select(F.lit(0).alias(ORDINAL), parsed.alias("_row"), F.json_object_keys("value").alias("_names"))
    else:
        # arrays_zip keeps each element's own text beside it, so that undeclared names show
        texts = F.from_json("value", "array<string>")
        rows = body.select(F.posexplode(F.arrays_zip(parsed.alias("row"), texts.alias("text"))).alias(ORDINAL, "_e"))
        rows = rows.select(ORDINAL, F.col("_e.row").alias("_row"), (F.lit(None).cast("array<string>") if shape == "scalars" else F.json_object_keys("_e.text")).alias("_names"))
    if shape == "scalars":
        out = rows.select(F.col("_row").alias(schema[0].name), ORDINAL)
    else:
        known = F.array(*[F.lit(f.name) for f in sent])
        none_where(rows, F.size(F.array_except("_names", known)) > 0, "a body holds undeclared fields")
        at = lambda s, f: tagged(F.col("_row").getField(s.name)) if f.dataType == TAGGED_SCALAR else F.col("_row").getField(s.name).cast(f.dataType)
        out = rows.select(*[at(s, f).alias(f.name) for s, f in zip(sent, schema)], ORDINAL)
    for f in schema:
        if not f.nullable:
            none_where(out, F.col(f.name).isNull(), f"{f.name} is null")
    return out.withColumn(ORDINAL, F.col(ORDINAL).cast("long"))


def constrained(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Each rule is an SQL predicate that must hold or be null on every row; one pass counts the breaches of all."""
    if rules:
        seen = df.agg(*[F.count_if(~F.expr(r)).alias(n) for n, r in rules.items()]).first()
        if bad := {n: seen[n] for n in rules if seen[n]}:
            raise ContractError(f"rows break rules: {bad}")
    return df
