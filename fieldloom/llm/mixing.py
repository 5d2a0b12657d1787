"""Temperature mixing: exponentiated source shares, a bisected exponent, and budgeted block permutations."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._shared import materialize, ship_package, text_of

#: Tokens in a block of a source, about.
BLOCK_TOKENS = 262_144
#: Each pass of the bisection tries so many exponents at once.
TRIED, PASSES = 32, 8
#: Up to so many rows taken beyond the first that doesn't fit are sent to all workers.
BROADCAST_ROWS = 1_000_000
#: Weights are kept as whole billionths, so that quotas are whole-number arithmetic.
UNIT = 1_000_000_000


def n_tokens(column: str = "text"):
    """Words between runs of ASCII white space."""
    return F.size(F.filter(F.split(text_of(column), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def _hash(*parts):
    """A number from 0 to 2^60 - 1 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def source_of():
    return F.coalesce(F.col("source"), F.lit(""))


def exponent(totals: DataFrame, budget: int, target_entropy: float | None, max_repeat: float | None) -> float:
    """The exponent of token shares that meets the target, found by cutting an interval of exponents again and again.

    target_entropy is a share of the largest possible entropy, ln(sources): the largest exponent of at most 1 that
    reaches it is taken. max_repeat bounds budget x weight / tokens for every source, and wins over the entropy: the
    exponent rises until it holds. Sums over sources run on the cluster, so their number is not bounded.
    """
    totals = totals.where("tokens > 0")
    n, everything = totals.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0

    def measured(low: float, high: float) -> list[tuple[float, float, float]]:
        tried = [low + (high - low) * k / TRIED for k in range(TRIED + 1)]
        a = F.explode(F.array(*map(F.lit, tried))).alias("a")
        lnp = F.log(F.col("tokens") / everything)
        each = totals.select(a, lnp.alias("lnp")).select("a", "lnp", F.exp(F.col("a") * F.col("lnp")).alias("w"))
        sums = each.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("a") * F.col("lnp")).alias("s"), F.max((F.col("a") - 1) * F.col("lnp")).alias("r"))
        return sorted((r.a, math.log(r.z) - r.s / r.z, budget / everything * math.exp(r.r) / r.z) for r in sums.collect())

    def largest(holds) -> float:
        """The end of the exponents from 0 on for which holds is true; holds turns once."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            seen = measured(low, high)
            good = [a for a, h, r in seen if holds(h, r)]
            if len(good) == len(seen):
                return high
            if not good:
                return low
            low, high = good[-1], min(a for a, *_ in seen if a > good[-1])
        return low

    a = 1.0 if target_entropy is None else largest(lambda h, _: h >= target_entropy * math.log(n))
    if max_repeat is not None:
        low = largest(lambda _, r: r > max_repeat)
        a = max(a, low + 1 / TRIED**PASSES if low else low)
    return min(1.0, a)


_FIT = "source string, block long, key long"


def _fitting(group: pa.Table) -> pa.Table:
    """Of the last block's keys in order, each that still fits into what is left of the quota."""
    group = group.sort_by("key")
    left, taken = group.column("room")[0].as_py(), []
    for k, n in enumerate(group.column("n").to_pylist()):
        if n <= left:
            left -= n
            taken.append(k)
    return group.select(["source", "block", "key"]).take(pa.array(taken, pa.int64()))


def plan(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.98, max_repeat: float | None = 2.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, blocks, fitting): rows are doc_id, source, n_tokens, block and key; blocks say what the mixture takes of each block.

    blocks holds source, block, place (of the block in its source's permutation), passes (whole passes over the
    source) and whole (the last, partial pass takes all of the block). fitting holds source, block and key of the rows
    that the last pass takes of the block in which the quota ends: in order of their keys, each that still fits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of().alias("source"), n_tokens().alias("n_tokens"))
    rows = materialize(rows, "tokens")
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = int(everything * budget_share)
    a = exponent(totals, budget, target_entropy, max_repeat)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / max(1, everything), F.lit(a))).otherwise(0.0)
    z = totals.select(F.sum(weight)).first()[0] or 1.0
    billionths = F.round(weight / z * UNIT).cast("decimal(38,0)")
    quota = totals.select("source", "tokens", F.floor(billionths * budget / UNIT).cast("long").alias("quota"))
    quota = quota.select(
        "source",
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("n_blocks"),
        F.expr("if(tokens > 0, quota div tokens, 1)").cast("int").alias("passes"),
        F.expr("if(tokens > 0, quota % tokens, 0)").alias("rest"),
    )
    rows = rows.join(quota, "source")
    rows = rows.withColumn("key", _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("block", F.col("key") % F.col("n_blocks"))
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(_hash(F.lit(seed), "source", "passes", "block"), "block")
    sums = sums.withColumn("place", F.row_number().over(order) - 1)
    sums = sums.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    sums = materialize(sums, "blocks")
    split = sums.where("before < rest and before + tokens > rest").select("source", "block", "before")
    ship_package(docs.sparkSession)
    inside = rows.join(split, ["source", "block"]).groupBy("source", "block", "key").agg(F.sum("n_tokens").alias("n"), F.first(F.col("rest") - F.col("before")).alias("room"))
    fitting = materialize(inside.where("n <= room").groupBy("source", "block").applyInArrow(_fitting, _FIT), "fitting")
    blocks = sums.select("source", "block", "place", "passes", F.expr("before + tokens <= rest and rest > 0").alias("whole"))
    fitting = F.broadcast(fitting) if fitting.count() <= BROADCAST_ROWS else fitting
    return rows.select("doc_id", "source", "n_tokens", "block", "key", "n_blocks"), blocks, fitting


def mixture(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.98, max_repeat: float | None = 2.0, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place) for every time the mixture uses a row of docs.

    The weights are the token shares to the found exponent, normalised; a source's quota is its weight of the budget
    (budget_share of all tokens). Whole passes take every row; the last takes blocks in the order of a permutation
    drawn for that pass, and of the block in which the quota ends, in order of a hash, each row that still fits, ties together.
    The quota is never exceeded. Sources whose rows have no tokens pass once. A null source is the source ''; null and
    empty texts have no tokens; rows that repeat a doc_id are taken together; an empty table gives no rows.
    """
    rows, blocks, fitting = plan(docs, budget_share, target_entropy, max_repeat, seed)
    used = rows.join(blocks, ["source", "block"]).join(fitting.withColumn("fits", F.lit(True)), ["source", "block", "key"], "left")
    used = used.withColumn("times", F.expr("passes + int(whole or fits is not null)")).where("times > 0")
    return used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), "block", "place")


def mixed(docs: DataFrame, budget_share: float = 0.95, target_entropy: float | None = 0.98, seed: int = 0) -> DataFrame:
    """The rows of docs that a mixture without repetition uses, with their columns."""
    rows, blocks, fitting = plan(docs, budget_share, target_entropy, 1.0, seed)
    taken = blocks.select("source", "block", "passes", "whole")
    sizes = rows.groupBy("source").agg(F.first("n_blocks").alias("n_blocks"))
    key = _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    d = docs.withColumn("_source", source_of()).withColumn("_key", key)
    d = d.join(sizes.withColumnRenamed("source", "_source"), "_source").withColumn("_block", F.col("_key") % F.col("n_blocks"))
    d = d.join(taken.toDF("_source", "_block", "_passes", "_whole"), ["_source", "_block"])
    d = d.join(fitting.toDF("_source", "_block", "_key").withColumn("_fits", F.lit(True)), ["_source", "_block", "_key"], "left")
    return d.where("_passes > 0 or _whole or _fits is not null").select(*docs.columns)
