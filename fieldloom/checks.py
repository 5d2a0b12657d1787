"""Fail-closed checks. Each is an aggregate or an anti-join of its own, so that the optimizer can't drop it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.errors import ContractError
from fieldloom.names import col, cols


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null in part or stand on more than one row, with their number of rows."""
    null = F.lit(False)
    for k in keys:
        null = null | col(k).isNull()
    return df.groupBy(*cols(keys)).agg(F.count("*").alias("n_rows")).where(null | (F.col("n_rows") > 1))


def keys_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if bad := key_violations(df, keys).take(1):
        raise ContractError(f"key {dict(zip(keys, bad[0]))} is null or repeated")
    return df


def outside(df: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the universe doesn't hold."""
    return df.join(universe.select(*cols(keys)).distinct(), list(keys), "left_anti")


def within_universe(df: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    if bad := outside(df, universe, keys).take(1):
        raise ContractError(f"a row lies outside the base: {bad[0]}")
    return df


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """The key sets of both sides must be equal."""
    within_universe(a, b, keys)
    within_universe(b, a, keys)


def none_where(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Raise if any row meets the condition."""
    if bad := df.where(condition).take(1):
        raise ContractError(f"{what}: {bad[0]}")
    return df


def guarded(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """The rows, of which the first to meet a rule's condition fails the query with the rule's message.

    The rules are part of the plan: they cost no pass of their own and hold for whatever the query reads. The filter that
    carries them can't be dropped, whichever columns are asked for.
    """
    ok = None
    for bad, what in rules:
        ok = (F if ok is None else ok).when(bad, F.raise_error(F.lit(f"contract: {what}")).cast("boolean"))
    return df if ok is None else df.where(F.coalesce(ok.otherwise(F.lit(True)), F.lit(True)))


def disorder(df: DataFrame, ordinal: str, by: Sequence[str]) -> DataFrame:
    """Neighbours in the order of `ordinal` that aren't in the order of `by`, nulls last, or the same order twice: (low, high) ordinals.

    Rows are dealt into ranges of the ordinal and compared within them, many at a time; then the first and last rows of the ranges are
    compared, of which there are two a partition.
    """
    key = F.struct(*[c for name in by for c in (col(name).isNull().alias(f"n_{name}"), col(name).alias(f"v_{name}"))])
    rows = df.select(col(ordinal).alias("at"), key.alias("key")).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    ends = rows.groupBy("part").agg(F.min_by(F.struct("at", "key"), "at").alias("first"), F.max_by(F.struct("at", "key"), "at").alias("last"))
    pair = lambda w: (F.lag("at").over(w).alias("low"), F.col("at").alias("high"), F.lag("key").over(w).alias("before"), "key")
    within = rows.select(*pair(Window.partitionBy("part").orderBy("at")))
    across = ends.select(F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("l"), "first")
    across = across.select(F.col("l.at").alias("low"), F.col("first.at").alias("high"), F.col("l.key").alias("before"), F.col("first.key").alias("key"))
    return within.unionByName(across).where(F.col("low").isNotNull() & (F.col("before") > F.col("key"))).select("low", "high")


def ordered(df: DataFrame, ordinal: str, by: Sequence[str]) -> DataFrame:
    """Rows in the order of `ordinal` must already be in the order of `by`, nulls last."""
    if bad := disorder(df, ordinal, by).take(1):
        raise ContractError(f"rows are out of order: {bad[0]}")
    return df
