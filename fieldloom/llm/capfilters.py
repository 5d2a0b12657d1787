"""Embedding near-duplicates by spherical-cap filters: random product codes, list decoding, a join on filters, verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import dealt_by, fold_links, materialize, partitions, ship_package, sorted_groups
from fieldloom.llm.components import connected_components

COSINE = 0.98
#: Vectors in a filter, about, when those of a label are spread evenly.
IN_FILTER = 32
#: Standard deviations of the difference of two filters' products that list decoding allows for.
DEVIATIONS = 5.5
#: A first half with more is compared in tiles of so many vectors and so many probes.
DATA, PROBES = 8192, 65_536
_BLOCK = 512
SEED = 20_01


class ProductCode:
    """Filters are sums of two unit vectors, one of `size` for each half of the coordinates after a random rotation.

    A vector lies in the filter with the largest product, its top. If y is at an angle of at most t from x, then y's top
    c satisfies <x, c> >= <x, top of x> - tan(t) <r, top of x - c> for a unit vector r across x, and after the rotation
    <r, top of x - c> has a standard deviation of at most sqrt(2 / dimensions). So x probes every filter whose product
    is within DEVIATIONS such steps of its largest, and meets y in y's one filter.
    """

    def __init__(self, dim: int, size: int, cosine: float):
        rng = np.random.default_rng([SEED, dim, size])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.half = max(1, dim // 2)
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        self.first = unit(rng.normal(size=(size, self.half)))
        self.second = unit(rng.normal(size=(size, dim - self.half))) if dim > self.half else np.zeros((1, 0))
        step = math.sqrt(1 - cosine**2) / cosine * math.sqrt(2 / dim)
        self.gap = DEVIATIONS * step * math.sqrt(2)  # of sums of products, which are sqrt(2) times those with unit filters

    def decode(self, unit: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, top filter, all filters within the gap) of unit vectors."""
        z = unit @ self.rotation
        a, b = z[:, : self.half] @ self.first.T, z[:, self.half :] @ self.second.T
        n = b.shape[1]
        for i in range(len(unit)):
            x, y = a[i], b[i]
            hx, hy = x.max(), y.max()
            p, q = np.flatnonzero(x >= hx - self.gap), np.flatnonzero(y >= hy - self.gap)
            u, v = np.nonzero(x[p][:, None] + y[q][None] >= hx + hy - self.gap)
            yield i, int(x.argmax()) * n + int(y.argmax()), p[u] * n + q[v]


def _unit(column: pa.Array, single: bool) -> np.ndarray:
    """Raw vectors of one length as unit vectors in double precision."""
    m = np.frombuffer(b"".join(column.to_pylist()), np.float32 if single else np.float64).astype(np.float64).reshape(len(column), -1)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as their bytes."""
    for rb in batches:
        x = rb.column(3)
        flat, cut = x.flatten().to_numpy(), np.r_[0, np.cumsum(x.value_lengths().to_numpy())]
        raw = pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*rb.columns[:3], raw], ["node", "label", "copies", "raw"])


def _probes(size: int, cosine: float, single: bool, with_vectors: bool):
    """Rows of filters that share a first half: one that stores the vector under its top, and one for each first half that it probes."""
    codes: dict[int, ProductCode] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            length = np.array([len(x) for x in rb.column(3).to_pylist()])
            for dim in np.unique(length // (4 if single else 8)).tolist():
                rows = np.flatnonzero(length == dim * (4 if single else 8))
                code = codes.setdefault(dim, ProductCode(dim, size, cosine))
                who, first, kind, lists = [], [], [], []
                n = len(code.second)
                for i, top, near in code.decode(_unit(rb.column(3).take(pa.array(rows)), single)):
                    p, q = near // n, near % n
                    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])  # filters come in order of their first halves
                    who += [rows[i]] * (len(cut) + 1)
                    first += [top // n, *p[cut].tolist()]
                    kind += [0] + [1] * len(cut)
                    lists += [[top % n], *(x.tolist() for x in np.split(q, cut[1:]))]
                take = pa.array(np.array(who, np.int64))
                cols = [rb.column(1).take(take), pa.array([dim] * len(who), pa.int32()), pa.array(first, pa.int32()), pa.array(kind, pa.int8())]
                names = ["label", "dim", "half", "kind"]
                if with_vectors:
                    cols += [rb.column(0).take(take), rb.column(2).take(take), pa.array(lists, pa.list_(pa.int32())), rb.column(3).take(take)]
                    names += ["node", "copies", "others", "raw"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _verify(cosine: float, single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, "label", "dim", "half", "tile", "part"):
            kind, node, copies = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("kind", "node", "copies"))
            if kind.all() or not kind.any():
                continue
            others = rows.column("others").combine_chunks()
            at = np.repeat(np.arange(len(node)), others.value_lengths().to_numpy())
            second = others.flatten().to_numpy()
            stored = kind[at] == 0
            data, probe = at[stored], at[~stored]
            d_of, p_of = second[stored], second[~stored]
            d_order, p_order = np.argsort(d_of, kind="stable"), np.argsort(p_of, kind="stable")
            data, d_of, probe, p_of = data[d_order], d_of[d_order], probe[p_order], p_of[p_order]
            m = _unit(rows.column("raw").combine_chunks(), single)
            label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
            for q in np.unique(d_of):
                ds = data[np.searchsorted(d_of, q) : np.searchsorted(d_of, q, "right")]
                ps = probe[np.searchsorted(p_of, q) : np.searchsorted(p_of, q, "right")]
                for k in range(0, len(ps), _BLOCK):
                    p = ps[k : k + _BLOCK]
                    i, j = np.nonzero((m[p] @ m[ds].T >= cosine) & (node[p][:, None] != node[ds][None]))
                    if len(i):
                        links += np.bincount(p[i], copies[ds[j]], len(node)).astype(np.int64)
                        label = fold_links(label, p[i], ds[j])
            told = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
            if len(told):
                yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told]), pa.array(node[label[told]])], ["node", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, in_filter: int = IN_FILTER) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and the cosine of their doubles is at least `cosine`. Equal
    vectors of a label are compared once, for all of them. Each is stored under one filter and probes several, so that
    each link is met once in each direction and counted without listing pairs; what leaves a tile is counts and a
    spanning forest. A vector travels once for each first half of the filters that it probes. The number of filters
    follows the largest label; first halves with many vectors or probes are split into tiles, all of which meet.
    Vectors that are null, empty, zero, of another length, or hold null or non-finite components link with nothing, nor
    does a null vec_id. Rows equal in all three columns are one vector; other rows that share a vec_id are rows of
    their own, which have all links of that id. Labels are whole numbers of any width up to 64 bits.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    n, ids = v.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if n != ids:
        v = v.dropDuplicates(["vec_id", "label", "embedding"])
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    key = ["label", "h", "i"]
    hashed = v.withColumns({"h": F.xxhash64("label", "embedding"), "i": F.xxhash64(F.lit(1), "embedding")})
    usable = hashed.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    classes = usable.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    size = max(4, 2 ** math.ceil(math.log2(max(1, most / in_filter)) / 2))
    raw = classes.select("node", "label", "copies", "embedding").mapInArrow(_raw, "node long, label long, copies long, raw binary")
    bucket = ["label", "dim", "half"]
    met = raw.mapInArrow(_probes(size, cosine, single, False), "label long, dim int, half int, kind byte")
    met = met.groupBy(*bucket).agg(F.sum(1 - F.col("kind").cast("int")).alias("data"), F.sum(F.col("kind").cast("int")).alias("probes"))
    parts = [F.ceil(F.col("data") / DATA).cast("int").alias("tiles"), F.ceil(F.col("probes") / PROBES).cast("int").alias("parts")]
    split = materialize(met.where(f"data > {DATA} or probes > {PROBES}").where("data > 0").select(*bucket, *parts), "split")
    rows = raw.mapInArrow(_probes(size, cosine, single, True), "label long, dim int, half int, kind byte, node long, copies long, others array<int>, raw binary")
    rows = rows.join(split, bucket, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stored = F.col("kind") == 0
    rows = rows.withColumn("tile", F.explode(F.when(stored, F.array(own("tiles"))).otherwise(all_of("tiles"))))
    rows = rows.withColumn("part", F.explode(F.when(stored, all_of("parts")).otherwise(F.array(own("parts")))))
    rows = rows.select(*bucket, "tile", "part", "kind", "node", "copies", "others", "raw")
    found = dealt_by(rows, 4 * partitions(spark), *bucket, "tile", "part").mapInArrow(_verify(cosine, single), "node long, n long, root long")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = connected_components(found, "node", "root")
    told = classes.select(*key, "node", "copies").join(links, "node", "left").join(comps, "node", "left")
    told = told.select(*key, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    mine = usable.select("vec_id", *key).join(told, key).groupBy("vec_id").agg(F.sum("n").cast("long").alias("n"), F.min("c").alias("c"))
    out = v.select("vec_id").join(mine, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
