"""K-d tree sharding in DataFrame operations alone: cut at byte-weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._shared import materialize, text_of

#: A node's cut is found by passes of so many bins, each inside the bin where the one before it ended.
BITS, PASSES = 12, 3
#: A coordinate has 20 bits; below it, 43 bits of a hash of doc_id order the rows of one coordinate.
COORD, TIE = 20, 43
#: Rows of a shard are numbered in so many runs, so that no shard is one task's work.
RUNS = 64


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie and the coordinates x0 (source), x1 (language), x2 (size), each of 20 bits."""
    text = text_of()
    size = (F.octet_length(text) + 16).cast("long")
    place = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), 32 - COORD)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - TIE).alias("tie"),
        place("source").alias("x0"),
        place("lang").alias("x1"),
        F.least(F.lit(2**COORD - 1), F.floor(F.log2(size.cast("double")) * (2**COORD / 40))).cast("long").alias("x2"),
    )


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Assign every row of (doc_id, text, source, lang) to a shard; sizes in bytes come out near equal.

    The tree splits a node of k leaves into k // 2 and the rest, at that share of its bytes, along the coordinate
    whose range within the node is widest. Give `shards`, or `target_bytes` from which the count follows. Rows of one
    coordinate, a hot source among them, are cut by a hash of doc_id. Null texts have 0 bytes and each row 16 more;
    null source and language count as empty. Rows that repeat a doc_id go the same way. An empty table gives none.
    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 by doc_id within runs), grown_shard (null).
    """
    rows = materialize(measured(docs), "measured")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    at = rows.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards))
    for level in range(max(0, (shards - 1).bit_length())):
        at = materialize(_split(at, shards), f"level-{level}")
    return _numbered(at)


def _split(at: DataFrame, shards: int) -> DataFrame:
    """One level: every node with two or more leaves is cut in two. Node tables have a row for each node, `shards` at most."""
    small = F.broadcast if shards <= 100_000 else lambda df: df
    open_rows = at.where("leaves > 1")
    dims = ("x0", "x1", "x2")
    ends = [f(x).alias(f"{n}_{x}") for x in dims for f, n in ((F.min, "lo"), (F.max, "hi"))]
    box = open_rows.groupBy("node").agg(*ends, F.sum("size").alias("bytes"), F.first("leaves").alias("leaves"))
    width = [F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in dims]
    widest = F.when((width[0] >= width[1]) & (width[0] >= width[2]), 0).when(width[1] >= width[2], 1).otherwise(2)
    node = box.select(
        "node",
        widest.alias("axis"),
        (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("want"),
        F.lit(0).cast("long").alias("low"),
        F.lit(0).cast("long").alias("below"),
    )
    key = F.expr(f"shiftleft(case axis when 0 then x0 when 1 then x1 else x2 end, {TIE}) + tie")
    for p in range(PASSES):
        span = COORD + TIE - BITS * (p + 1)  # bits of a key below this pass's bin
        own = open_rows.select("node", "size", *dims, "tie").join(small(node), "node").withColumn("key", key)
        if p:
            own = own.where(F.shiftright("key", span + BITS) == F.shiftright("low", span + BITS))
        hist = own.groupBy("node", F.shiftright("key", span).alias("bin")).agg(
            F.sum("size").alias("bytes"), *(F.first(c).alias(c) for c in ("axis", "want", "below"))
        )
        before = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        hist = hist.withColumn("start", F.col("below") + F.coalesce(before, F.lit(0)))
        last = F.struct("bin", "start", "bytes", "axis", "want")
        found = hist.where("start <= want").groupBy("node").agg(F.max(last).alias("b"))  # the bin in which the wanted byte lies
        node = found.select("node", "b.axis", "b.want", F.shiftleft("b.bin", span).alias("low"), F.col("b.start").alias("below"), "b.bytes")
    nearer = F.expr(f"low + if(below + bytes - want < want - below, shiftleft(1L, {span}), 0L)")
    cut = node.select("node", "axis", nearer.alias("cut"))
    out = at.join(small(cut), "node", "left").withColumn("right", F.coalesce(key >= F.col("cut"), F.lit(False)))
    half = F.floor(F.col("leaves") / 2).cast("int")
    split = F.col("leaves") > 1
    return out.select(
        *(c for c in at.columns if c not in ("node", "leaves")),
        F.when(F.col("right"), F.col("node") + half).otherwise(F.col("node")).cast("int").alias("node"),
        F.when(~split, 1).when(F.col("right"), F.col("leaves") - half).otherwise(half).cast("int").alias("leaves"),
    )


def _numbered(at: DataFrame) -> DataFrame:
    at = at.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).alias("run"))
    sizes = at.groupBy("shard", "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("shard", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32"))
    out = at.withColumn("nth", nth).join(start, ["shard", "run"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
