"""Joins that keep the base rows: coverage instead of silent loss, and failures instead of guesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.checks import guarded, keys_unique, none_where, within_universe
from fieldloom.errors import ContractError


def enrich_left(base: DataFrame, other: DataFrame, keys: Sequence[str], *, coverage: str, outside: str = "error", partial: str = "allow", conflict: Column | None = None) -> DataFrame:
    """Left join of at most one row, with a coverage column 'present' or 'empty' from a marker of the other side.

    outside: rows of `other` beyond the base raise ('error') or are left out ('ignore'). partial: with 'error', a side
    that has rows must cover the whole base. conflict: over joined rows, must never hold.
    """
    keys_unique(other, keys)
    if outside == "error":
        within_universe(other, base, keys)
    joined = base.join(other.withColumn("_there", F.lit(True)), list(keys), "left")
    joined = joined.withColumn(coverage, F.when(F.col("_there"), "present").otherwise("empty"))
    if conflict is not None:
        none_where(joined, F.col("_there") & conflict, "joined rows disagree")
    if partial == "error" and not other.isEmpty():
        none_where(joined, F.col(coverage) == "empty", "the other side covers the base in part")
    return joined.drop("_there")


def require_complete(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which every base row finds exactly one row."""
    keys_unique(other, keys)
    within_universe(base, other, keys)
    return base.join(other, list(keys), "inner")


def enrich_collect(base: DataFrame, other: DataFrame, keys: Sequence[str], *, ordinal: str, into: str, coverage: str, outside: str = "error") -> DataFrame:
    """Left join of any number of rows, as a list in the order of the ordinal; none gives an empty list and 'empty'."""
    if outside == "error":
        within_universe(other, base, keys)
    rest = [c for c in other.columns if c not in keys and c != ordinal]
    lists = other.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ordinal, *rest))).alias(into))
    joined = base.join(lists, list(keys), "left")
    return joined.withColumn(coverage, F.when(F.col(into).isNotNull(), "present").otherwise("empty")).withColumn(into, F.coalesce(into, F.expr("array()")))


def range_one(base: DataFrame, ranges: DataFrame, on: Sequence[str], *, value: str, start: str, end: str, id_columns: Sequence[str]) -> DataFrame:
    """Join each base row with the one range of its key with start <= value <= end (null: open); none or several raise.

    Rows and ends of ranges are swept together in order, once: a count of open ranges and the exclusive-or of their
    hashes run along, so where one is open that is its hash. No row meets all ranges of its key. Hashes are of whole ranges.
    """
    r = ranges.where(F.col(start).isNotNull()).withColumn("_hash", F.xxhash64(*ranges.columns))
    kind = base.schema[value].dataType
    none = F.lit(None).cast(base.schema.simpleString())
    event = lambda df, at, place, step, h, row: df.select(*on, F.col(at).cast(kind).alias("_at"), F.lit(place).alias("_place"), F.lit(step).alias("_step"), h.alias("_hash"), row.alias("_row"))
    rows = event(base, value, 1, 0, F.lit(0).cast("long"), F.struct(*base.columns))
    sweep = rows.unionAll(event(r, start, 0, 1, F.col("_hash"), none)).unionAll(event(r.where(F.col(end).isNotNull()), end, 2, -1, F.col("_hash"), none))
    along = Window.partitionBy(*on).orderBy("_at", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = sweep.withColumns({"_n": F.sum("_step").over(along), "_hash": F.bit_xor("_hash").over(along)}).where("_place = 1")
    open_ = open_.withColumn("_n", F.when(F.col("_at").isNull(), 0).otherwise(F.col("_n")))
    if bad := open_.where("_n != 1").select("_n", *[F.col("_row").getField(c).alias(c) for c in id_columns]).take(1):
        raise ContractError(f"{bad[0]._n} ranges match {bad[0]}")
    rest = [c for c in ranges.columns if c not in on]
    return open_.select("_row.*", *[F.col(k).alias(f"_on_{k}") for k in on], "_hash").join(
        r.select("_hash", *[F.col(k).alias(f"_on_{k}") for k in on], *[F.col(c).alias(f"_of_{c}") for c in rest]), ["_hash", *[f"_on_{k}" for k in on]]
    ).select(*base.columns, *[F.col(f"_of_{c}").alias(c) for c in rest])


def semi_any(df: DataFrame, columns: Sequence[str], ids: DataFrame, key: str) -> DataFrame:
    """The rows, once each, of which any of the columns is among the ids. No join on an OR: each column meets the distinct ids by itself."""
    known = ids.select(F.col(key).alias("_id")).distinct().withColumn("_there", F.lit(True))
    out = df
    for k, c in enumerate(columns):
        out = out.join(known.select(F.col("_id").alias(f"_id{k}"), F.col("_there").alias(f"_there{k}")), F.col(c) == F.col(f"_id{k}"), "left")
    any_ = None
    for k, _ in enumerate(columns):
        any_ = F.col(f"_there{k}").isNotNull() if any_ is None else any_ | F.col(f"_there{k}").isNotNull()
    return out.where(any_).select(*[F.col(f"`{c}`") for c in df.columns])


def coverage_of(covered: Column, total: Column) -> Column:
    """'empty', 'partial' or 'complete': all or nothing is the rule where an enrichment is asked for."""
    return F.when(covered == 0, "empty").when(covered == total, "complete").otherwise("partial")


def outer_union(a: DataFrame, b: DataFrame, keys: Sequence[str], *, status: str, names: tuple[str, str, str] = ("both", "left_only", "right_only")) -> DataFrame:
    """Full outer join of unique keys with a status; clashing columns take the left side's value first."""
    keys_unique(a, keys)
    keys_unique(b, keys)
    x, y = a.withColumn("_a", F.lit(True)).alias("x"), b.withColumn("_b", F.lit(True)).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    j = x.join(y, on, "full_outer")
    shared = [c for c in a.columns if c in b.columns]
    pick = [F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) if c in shared else F.col(f"x.{c}") for c in a.columns]
    pick += [F.col(f"y.{c}") for c in b.columns if c not in shared]
    return j.select(*pick, F.when(F.col("_a") & F.col("_b"), names[0]).when(F.col("_a"), names[1]).otherwise(names[2]).alias(status))


def concat(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; nothing is deduplicated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which both sides have unique keys."""
    keys_unique(a, keys)
    keys_unique(b, keys)
    return a.join(b, list(keys), "left")


def attach(base: DataFrame, other: DataFrame, keys: Sequence[str], *, into: str, outside: str = "error", label: str = "") -> DataFrame:
    """Left join of the one row of `other`, whose column `into` is a struct. The checks are part of the plan.

    A key that `other` holds twice fails the query; so does one outside the base, where `outside` is 'error'.
    """
    o = other.groupBy(*keys).agg(F.first(into).alias(into), F.count("*").alias("_times"))
    j = base.withColumn("_base", F.lit(True)).join(o, list(keys), "full_outer" if outside == "error" else "left")
    rules = [(F.col("_times") > 1, f"{label or into}: a key is there twice")]
    if outside == "error":
        rules.insert(0, (F.col("_base").isNull(), f"{label or into}: a row lies outside the base"))
    elif outside != "ignore":
        raise ContractError("outside must be error or ignore")
    return guarded(j, *[(F.coalesce(c, F.lit(False)), w) for c, w in rules]).drop("_base", "_times")
