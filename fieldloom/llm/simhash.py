"""SimHash near-duplicates: exact tiled comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import dealt_by, fold_links, materialize, partitions, ship_package, sorted_groups, text_of
from fieldloom.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a tile; a larger class of bit counts is dealt into more tiles.
TILE = 65_536
#: Rows and columns of the blocks in which two tiles are compared.
ROWS, COLUMNS = 128, 1024
_AT_ONCE = 1 << 15


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64 bits as a signed number: each is the majority over the XXH64 of all word shingles of the whole text."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    n = max(1, len(words) - width + 1)
    start, end = start[:n].tolist(), end[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _AT_ONCE):
        h = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(start[k : k + _AT_ONCE], end[k : k + _AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        fp = pa.array([fingerprint(t.as_py()) for t in rb.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([rb.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the radius, block by block.

    Rows are put in order of the bit counts of their four quarters; a block pair is skipped when the bounds of those
    counts lie further apart than the radius, since each differing bit changes one count by one.
    """
    count = lambda x: np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    key = lambda q: ((q[:, 0].astype(np.int64) * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3]
    qa, qb = count(a), count(b)
    oa, ob = np.argsort(key(qa), kind="stable"), np.argsort(key(qb), kind="stable")
    a, b, qa, qb = a[oa], b[ob], qa[oa], qb[ob]
    at = np.arange(0, len(b), COLUMNS)
    low, high = np.minimum.reduceat(qb, at), np.maximum.reduceat(qb, at)
    for i in range(0, len(a), ROWS):
        q = qa[i : i + ROWS]
        apart = np.maximum(0, np.maximum(low - q.max(0), q.min(0) - high)).sum(1)
        for k in np.flatnonzero(apart <= radius):
            j = at[k]
            if same and j + COLUMNS <= i:
                continue
            x, y = np.nonzero(np.bitwise_count(a[i : i + ROWS, None] ^ b[None, j : j + COLUMNS]) <= radius)
            if same:
                x, y = x[x + i < y + j], y[x + i < y + j]
            if len(x):
                yield oa[x + i], ob[y + j]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, "pair"):
            fp, node, side = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("fp", "node", "side"))
            fp = fp.view(np.uint64)
            first, second = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
            same = bool(len(side)) and side[0] == 1
            label = np.arange(len(fp))
            if len(first) and len(second):
                for i, j in near(fp[first], fp[second], radius, same):
                    label = fold_links(label, first[i], second[j])
            moved = np.flatnonzero(label != np.arange(len(fp)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return run


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join exactly the nodes of (fp, node) which chains of fingerprints within the radius join.

    Tiles are classes of equal bit counts in the upper and the lower half; at most 33 x 33 classes exist, so the
    directory and the pairs of classes are bounded whatever the input. Classes whose counts differ by more than the
    radius are never brought together. From a pair of tiles come the edges of a spanning forest, not all pairs.
    """
    spark = reps.sparkSession
    half = F.expr("int(bit_count(shiftrightunsigned(fp, 32)) * 33 + bit_count(fp & 4294967295L))")
    reps = reps.withColumn("kind", half)
    sizes = {r[0]: r[1] for r in reps.groupBy("kind").count().collect()}  # 1,089 rows at most
    tiles = {k: -(-n // tile) for k, n in sizes.items()}
    pairs = [(s, t, tiles[s], tiles[t]) for s in sizes for t in sizes if abs(s // 33 - t // 33) + abs(s % 33 - t % 33) <= radius]
    work = sum(sizes[s] * sizes[t] for s, t, _, _ in pairs) // 2
    met = spark.createDataFrame(pairs, "kind int, other int, own_tiles int, other_tiles int")
    r = reps.join(F.broadcast(met), "kind").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("own_tiles")))
    r = r.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    mine, yours = F.expr("kind * 1000000L + own"), F.expr("other * 1000000L + theirs")
    side = F.when(mine == yours, 1).when(mine < yours, 0).otherwise(2)
    r = r.select((F.least(mine, yours) * F.lit(2**31) + F.greatest(mine, yours)).alias("pair"), side.cast("byte").alias("side"), "fp", "node")
    n = max(partitions(spark), min(100_000, work // 2_000_000_000))
    return dealt_by(r, n, "pair").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, text); whole texts, all rows.

    Null and empty texts, and those of white space alone, have fingerprint zero and link as any other. Rows that
    repeat a doc_id give a row each, linked by its own fingerprint alone. A null doc_id links with nothing and has a
    null component.
    """
    slim = materialize(fingerprints(docs), "fingerprints")
    reps = slim.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    reps = materialize(reps.withColumn("node", F.col("fp")), "reps")  # ids may repeat, fingerprints don't
    comps = connected_components(links(reps.select("fp", "node"), radius))
    group = reps.join(comps, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("group"))
    of = group.join(group.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id")
    out = slim.join(of, "fp", "left").withColumn("component_id", F.expr("if(doc_id is null, null, component_id)"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-duplicate stage: word shingles, and the least similarity of their sets. Texts of that similarity differ in a share
#: of arccos(2 s / (1 + s)) / pi of the bits of their fingerprints, so many bits are the radius; the more bits, the closer.
WORDS, SIMILARITY, WIDE = 5, 0.8, 16
#: The first words of a wide fingerprint are compared first; beyond so many deviations over the radius' share the rest isn't looked at.
FIRST, SURE = 4, 7.0
#: Odd multipliers that spread one 64-bit hash over the words of a wide fingerprint.
_SPREAD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WIDE)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(line: bytes, width: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of normalised text; of fewer words the whole is one."""
    from xxhash import xxh64_digest

    words = line.split()
    if not words:
        return np.zeros(0, np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = max(1, len(words) - width + 1)
    start, end = (end - length)[:n].tolist(), end[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(start, end)]), ">u8").astype(np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDE words of 64 bits: each bit is the majority over the distinct shingles."""
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096, None] * _SPREAD
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def wide_radius(least: float = SIMILARITY) -> int:
    return int(64 * WIDE * np.arccos(2 * least / (1 + least)) / np.pi)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sets of hashes; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _normal(column: str = "text"):
    """A-Z lower-cased, words between ASCII white space joined by single spaces."""
    low = F.translate(text_of(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[ \\t\\n\\x0B\\f\\r]+", " "))


def _key(normal):
    """128 bits that stand for a normalised text."""
    return F.unhex(F.substring(F.sha2(normal, 256), 1, 32))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        each = [shingle_hashes(t.as_py().encode("utf-8", "surrogatepass")) for t in rb.column(1)]
        size = pa.array([len(h) for h in each], pa.int32())
        yield pa.RecordBatch.from_arrays([rb.column(0), size, pa.array([wide_fingerprint(h) for h in each], pa.binary())], ["key", "size", "fp"])


def wide_pairs(size: np.ndarray, fp: np.ndarray, first: np.ndarray, second: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius whose sizes allow the similarity, block by block; blocks whose bit counts or sizes can't fit are skipped."""
    radius = wide_radius(least)
    share = radius / (64 * WIDE)
    early = int(64 * FIRST * share + SURE * np.sqrt(64 * FIRST * share * (1 - share)))
    count = np.bitwise_count(fp).sum(1, dtype=np.int32)
    a, b = first[np.lexsort((count[first], size[first]))], second[np.lexsort((count[second], size[second]))]
    at = np.arange(0, len(b), COLUMNS)
    low, high = np.minimum.reduceat(count[b], at), np.maximum.reduceat(count[b], at)
    least_size, most_size = size[b][at], size[b][np.minimum(at + COLUMNS, len(b)) - 1]
    for i in range(0, len(a), ROWS):
        x = a[i : i + ROWS]
        c = count[x]
        fits = (np.maximum(low - c.max(), c.min() - high) <= radius) & (size[x].max() >= least * least_size) & (most_size >= least * size[x].min())
        for k in np.flatnonzero(fits):
            if same and at[k] + COLUMNS <= i:
                continue
            y = b[at[k] : at[k] + COLUMNS]
            differ = np.zeros((len(x), len(y)), np.uint16)
            for w in range(FIRST):
                differ += np.bitwise_count(fp[x, w][:, None] ^ fp[y, w])
            p, q = np.nonzero(differ <= early)
            p, q = x[p], y[q]
            fit = (p != q) & (np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]))
            p, q = p[fit], q[fit]
            near = np.bitwise_count(fp[p] ^ fp[q]).sum(1, dtype=np.int32) <= radius
            if near.any():
                yield p[near], q[near]


def _compare_wide(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, "pair"):
            side, node, size = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("side", "node", "size"))
            first, second = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
            if not len(first) or not len(second):
                continue
            fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
            label = np.arange(len(node))
            for i, j in wide_pairs(size.astype(np.int64), fp, first, second, side[0] == 1, least):
                label = fold_links(label, i, j)
            moved = np.flatnonzero(label != np.arange(len(node)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return run


def wide_links(nodes: DataFrame, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join exactly the nodes of (node, size, fp) which chains of fingerprints within the radius join.

    Tiles are classes of sizes, in steps of 1 / least, cut by a hash; a class meets itself and the next one only, as the
    sizes of similar sets allow no more. Classes are some tens, whatever the input.
    """
    spark = nodes.sparkSession
    step = float(np.log(1 / least)) * (1 - 1e-9)
    kind = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / step) + 1).otherwise(0).cast("int")
    nodes = nodes.withColumn("kind", kind)
    sizes = {r[0]: r[1] for r in nodes.groupBy("kind").count().collect()}
    tiles = {k: -(-n // tile) for k, n in sizes.items()}
    pairs = [(s, t, tiles[s], tiles[t]) for s in sizes for t in sizes if abs(s - t) <= 1]
    work = sum(sizes[s] * sizes[t] for s, t, _, _ in pairs) // 2
    met = spark.createDataFrame(pairs, "kind int, other int, own_tiles int, other_tiles int")
    r = nodes.join(F.broadcast(met), "kind").withColumn("own", F.pmod(F.xxhash64("node"), F.col("own_tiles")))
    r = r.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    mine, yours = F.expr("kind * 10000000L + own"), F.expr("other * 10000000L + theirs")
    side = F.when(mine == yours, 1).when(mine < yours, 0).otherwise(2)
    r = r.select((F.least(mine, yours) * F.lit(2**32) + F.greatest(mine, yours)).alias("pair"), side.cast("byte").alias("side"), "node", "size", "fp")
    n = max(partitions(spark), min(100_000, work // 500_000_000))
    return dealt_by(r, n, "pair").mapInArrow(_compare_wide(least), "a long, b long")


def near_texts(docs: DataFrame, least: float = SIMILARITY, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(classes, components): classes has key and node of each distinct normalised text, components has node and component.

    Texts link when the similarity that their wide fingerprints tell is at least `least`: the Jaccard similarity of the
    sets of their five-word shingles, within some hundredths. Fingerprints are compared exactly, tile by tile; texts
    equal but for case and white space are one.
    """
    ship_package(docs.sparkSession)
    normal = docs.select(_normal().alias("text")).select(_key(F.col("text")).alias("key"), "text")
    wide = normal.mapInArrow(_wide, "key binary, size int, fp binary")
    classes = wide.groupBy("key").agg(F.first("size").alias("size"), F.first("fp").alias("fp"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    return classes.select("key", "node"), connected_components(wide_links(classes, least, tile))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicate texts, with all columns of docs: the one with the smallest doc_id, null ids last.

    Each row is judged by its own text, so a doc_id that repeats with another text stays. Of rows equal in doc_id and
    text one stays. Null and empty texts are one group; an empty table gives no rows.
    """
    columns = docs.columns
    classes, joined = near_texts(docs, least)
    group = classes.join(joined, "node", "left").select(F.col("key").alias("_key"), F.coalesce("component", "node").alias("_group"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(text_of()).alias("t"))
    keyed = docs.withColumn("_key", _key(_normal())).withColumn("_rank", rank)
    best = keyed.select("_key", "_rank").groupBy("_key").agg(F.min("_rank").alias("_rank")).join(group, "_key")
    best = best.groupBy("_group").agg(F.min(F.struct("_rank", "_key")).alias("b")).select("b._key", F.col("b._rank").alias("_best"))
    left = keyed.join(materialize(best, "kept"), "_key").where(F.col("_rank").eqNullSafe(F.col("_best")))
    one = left.groupBy("_key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in columns])
