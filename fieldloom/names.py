"""Columns by their exact names, whatever stands in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str, of: str = "") -> Column:
    """The column of exactly this name: dots in it don't reach into structs."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def cols(names) -> list[Column]:
    return [col(n) for n in names]
