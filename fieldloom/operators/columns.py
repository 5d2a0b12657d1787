"""Strict column operators: selection, renaming, lossless casts and stable sorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.errors import TransformError
from fieldloom.names import col, cols

#: Types that strict casts reach.
PORTABLE = {"boolean": "boolean", "int64": "bigint", "float64": "double", "string": "string", "date32": "date", "timestamp[us]": "timestamp_ntz", "timestamp[us, UTC]": "timestamp"}

#: Texts that a strict cast reads, by the type; Spark alone would take more (white space, type letters, bare years, "yes").
TEXTS = {
    "boolean": r"^(true|false)$",
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?inf$|^NaN$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$",
}


def _present(df: DataFrame, columns: Sequence[str]) -> None:
    if not columns:
        raise TransformError("no columns are given")
    if len(set(columns)) != len(columns):
        raise TransformError("a column is given twice")
    if missing := [c for c in columns if c not in df.columns]:
        raise TransformError(f"no such columns: {missing}")


def select_columns(df: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    _present(df, columns)
    return df.select(*cols(columns))


def rename_columns(df: DataFrame, *, mapping: Mapping[str, str]) -> DataFrame:
    """One projection, so names can be swapped; a new name may not meet one that stays."""
    _present(df, list(mapping))
    if len(set(mapping.values())) != len(mapping):
        raise TransformError("two columns get one name")
    if clash := set(mapping.values()) & (set(df.columns) - set(mapping)):
        raise TransformError(f"names are taken: {sorted(clash)}")
    return df.select(*[col(c).alias(mapping.get(c, c)) for c in df.columns])


def loses(column: str | Column, source: str, target: str) -> Column:
    """True where a cast from the source to the target type would change or lose the value."""
    c = col(column) if isinstance(column, str) else column
    there = c.try_cast(target)
    if source == "string":
        plain = c.rlike(TEXTS[target]) if target in TEXTS else F.lit(True)
        return c.isNotNull() & ~(plain & there.isNotNull())
    return c.isNotNull() & ~there.try_cast(source).eqNullSafe(c)


def strict_cast_columns(df: DataFrame, *, columns: Mapping[str, str]) -> DataFrame:
    """Cast to portable types; a value that would change raises, nulls pass. One aggregate checks all columns."""
    _present(df, list(columns))
    if unknown := [t for t in columns.values() if t not in PORTABLE]:
        raise TransformError(f"no such types: {unknown}")
    kinds = dict(df.dtypes)
    counts = df.agg(*[F.count_if(loses(c, kinds[c], PORTABLE[t])) for c, t in columns.items()]).first()
    if lost := {c: n for c, n in zip(columns, counts) if n}:
        raise TransformError(f"casts would lose values: {lost}")
    return df.select(*[col(c).cast(PORTABLE[columns[c]]).alias(c) if c in columns else col(c) for c in df.columns])


def sort_rows(df: DataFrame, *, by: Sequence[str], descending: bool | Sequence[bool] = False, nulls_last: bool = True, ordinal: str | None = None) -> DataFrame:
    """Sort with a direction for each key and one place for nulls; with an ordinal column the sort is stable."""
    _present(df, by)
    down = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    if len(down) != len(by):
        raise TransformError("directions and keys differ in number")
    order = [getattr(col(c), f"{'desc' if d else 'asc'}_nulls_{'last' if nulls_last else 'first'}")() for c, d in zip(by, down)]
    return df.orderBy(*order, *([col(ordinal)] if ordinal else []))
