"""Nested values: paths, structs as columns, lists as rows, under explicit policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fieldloom.errors import TransformError
from fieldloom.names import col, cols


def nested_value(value: Column | str, *, path: Sequence[str | int], nulls: str = "error") -> Column:
    """Follow names into structs and maps and whole numbers (negative from the end) into lists; no dots are read."""
    if not 1 <= len(path) <= 32:
        raise TransformError("a path has 1 to 32 tokens")
    if nulls not in ("error", "return_null"):
        raise TransformError("nulls must be error or return_null")
    c = col(value) if isinstance(value, str) else value
    for t in path:
        if isinstance(t, bool) or not isinstance(t, (str, int)):
            raise TransformError(f"not a path token: {t!r}")
        c = c.getItem(t) if isinstance(t, str) else F.element_at(c, t + 1 if t >= 0 else t)
    return c if nulls == "return_null" else F.coalesce(c, F.raise_error(F.lit(f"no value at {list(path)}")))


def flatten_struct(df: DataFrame, *, field: str, fields: Sequence[str], prefix: str = "", retain_struct: bool = False, null_struct: str = "error") -> DataFrame:
    """Append a struct's fields as prefixed columns; `fields` must name all of them."""
    if field not in df.columns:
        raise TransformError(f"no such column: {field}")
    own = df.schema[field].dataType
    if sorted(getattr(own, "names", [])) != sorted(fields):
        raise TransformError(f"{field} doesn't have exactly the fields {list(fields)}")
    kept = [c for c in df.columns if retain_struct or c != field]
    if clash := set(kept) & {prefix + f for f in fields}:
        raise TransformError(f"names are taken: {sorted(clash)}")
    if null_struct == "error":
        if not df.where(col(field).isNull()).isEmpty():
            raise TransformError(f"{field} is null in a row")
    elif null_struct != "null_fields":
        raise TransformError("null_struct must be error or null_fields")
    return df.select(*cols(kept), *[col(field).getField(f).alias(prefix + f) for f in fields])


def explode_list(
    df: DataFrame, *, field: str, mode: str = "inner", null_list: str = "error", empty_list: str = "error", null_element: str = "error",
    ordinal_field: str | None = None, ordinal_start: int = 0,
) -> DataFrame:
    """One row for each element, in place of the list. Policies: error, drop (inner) or emit_null (outer); null_element: error, drop, keep.

    Ordinals count positions in the list, dropped elements too; a row that stands for a null or empty list has null for both.
    """
    outer = mode == "outer"
    if mode not in ("inner", "outer"):
        raise TransformError("mode must be inner or outer")
    for name, p in (("null_list", null_list), ("empty_list", empty_list)):
        if p not in ("error", "emit_null" if outer else "drop"):
            raise TransformError(f"{name}={p} doesn't fit an {mode} explode")
    if null_element not in ("error", "keep", *(() if outer else ("drop",))):
        raise TransformError(f"null_element={null_element} doesn't fit an {mode} explode")
    if ordinal_field in [c for c in df.columns if c != field]:
        raise TransformError(f"{ordinal_field} is taken")
    c = col(field)
    for policy, bad, what in ((null_list, c.isNull(), "is null"), (empty_list, F.size(c) == 0, "is empty"), (null_element, F.exists(c, lambda x: x.isNull()), "holds a null")):
        if policy == "error" and not df.where(bad).isEmpty():
            raise TransformError(f"{field} {what} in a row")
    each = (F.posexplode_outer if outer else F.posexplode)(c)
    rest = [x for x in df.columns if x != field]
    out = df.select(*cols(rest), each.alias("_at", field))
    if null_element == "drop":
        out = out.where(col(field).isNotNull())
    ordinal = [(F.col("_at") + ordinal_start).cast("long").alias(ordinal_field)] if ordinal_field else []
    return out.select(*cols(df.columns), *ordinal)


def explode_diagnostics(df: DataFrame, *, field: str) -> DataFrame:
    """One row: rows in, elements out, and rows and null elements that an inner explode leaves out."""
    c = col(field)
    n = F.when(F.size(c) > 0, F.size(c)).otherwise(0)
    return df.agg(
        F.count("*").alias("input_rows"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("output_rows"),
        F.count_if(c.isNull()).alias("null_lists"),
        F.count_if(F.size(c) == 0).alias("empty_lists"),
        F.coalesce(F.sum(F.size(F.filter(c, lambda x: x.isNull()))), F.lit(0)).cast("long").alias("null_elements"),
    )


def require_one(df: DataFrame) -> Row:
    rows = df.take(2)
    if len(rows) != 1:
        raise TransformError("exactly one row is required" + (", there is none" if not rows else ""))
    return rows[0]


def bind_value(df: DataFrame, column: str, kind: type):
    """A scalar for a later selector: the one row's value, of exactly the given type."""
    v = require_one(df.select(col(column)))[0]
    if type(v) is not kind:
        raise TransformError(f"{column} is {type(v).__name__}, not {kind.__name__}")
    return v


def perspectives(df: DataFrame, *, sides: Sequence[dict[str, Column | str]], ordinal: str = "perspective_ordinal", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each side of a row, in one pass; sides name the same output columns."""
    names = list(sides[0])
    if any(list(s) != names for s in sides):
        raise TransformError("sides differ in their columns")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = F.array(*[F.struct(F.lit(k).alias(ordinal), *[as_col(s[n]).alias(n) for n in names]) for k, s in enumerate(sides)])
    return df.select(*keep, F.explode(rows).alias("_side")).select(*keep, "_side.*")
