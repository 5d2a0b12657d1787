"""Repeated byte strings: column-wise construction of a positional Burrows-Wheeler transform over many documents.

Documents are cut into pieces around anchors. An anchor is the 200-byte string with the smallest hash within some
400-byte window, so every window holds one, and equal windows hold equal ones at equal places. Pieces with equal anchors
form a collection, aligned at the anchor. A collection is read column by column: each round inserts one symbol of
every document, keeps the documents in order of what was read before (the transform's order) and updates, for each
neighbour, where the common string of both begins. After a column, a window that ends there also occurs in another
document, or elsewhere in the same, just when the string shared with a neighbour is as long as the window. The
collections come from Spark's sorted shuffle files and are read from end to end, several at a time, never at random.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import dealt_by, materialize, partitions, ship_package, sorted_groups, text_of

LENGTH = 400
#: Pieces that are put in order at a time; collections aren't split.
AT_ONCE = 4096
#: A larger collection is cut into smaller ones first.
LARGEST = 50_000
#: So many of the commonest anchors, whatever the input, are counted apart: their rows meet a table sent to all workers instead of one task.
COMMONEST = 1000
_POSITION = 20
_LONGEST = 1024
_BLOCK = (1 << _POSITION) - _LONGEST
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _tables:
        n = 1 << _POSITION
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _tables[base] = (both[0], both[1])
    return _tables[base]


def gram_hashes(x: np.ndarray, gram: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes of x, equal for equal bytes at any place; x has at most 2^20 bytes."""
    up, down = _powers(base)
    n = len(x)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
    h = (p[gram:] - p[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in data, hashes) of the anchors of the documents that lie in data between offsets."""
    gram = length // 2
    w = length - gram + 1
    first, last = int(offsets[0]), int(offsets[-1])
    places, keys = [], []
    for b in range(first, last - length + 1, _BLOCK):
        x = data[b : min(last, b + _BLOCK + length - 1)]
        n = len(x) - length + 1  # windows that begin here
        whole = np.zeros(n, bool)
        i = max(0, int(np.searchsorted(offsets, b, "right")) - 1)
        while i < len(offsets) - 1 and offsets[i] < b + n:
            whole[max(0, int(offsets[i]) - b) : max(0, int(offsets[i + 1]) - length + 1 - b)] = True
            i += 1
        if not whole.any():
            continue
        h = gram_hashes(x, gram)
        low = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: n], low[w - size : w - size + n])
        low = low[:n][whole]
        at = np.unique(low[np.concatenate([[True], low[1:] != low[:-1]])] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        places.append(at + b)
        keys.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, once = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(keys)[once]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary column, without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offsets = _bytes_of(rb.column(1))
            place, key = anchors(data, offsets, length)
            cut = np.searchsorted(place, offsets).astype(np.int32)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(cut))
            at = pa.ListArray.from_arrays(pa.array(cut), pa.array((place - offsets[doc]).astype(np.int64)))
            keys = pa.ListArray.from_arrays(pa.array(cut), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rb.column(0), keys, at], ["text", "keys", "at"])

    return run


def _cut_pieces(length: int):
    gram = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                body, found = rb.column(1)[i].as_py(), rb.column(2)[i].as_py()
                for k in range(0, len(found), 20_000):
                    part = found[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f["key"] for f in part], pa.int64()),
                            pa.array([rb.column(0)[i].as_py()] * len(part), pa.binary()),
                            pa.array([f["at"] for f in part], pa.int64()),
                            pa.array([f["n"] for f in part], pa.int64()),
                            pa.array([body[max(0, f["at"] - gram) : f["at"] + length] for f in part], pa.binary()),
                        ],
                        ["key", "text", "at", "n", "piece"],
                    )

    return run


def repeated_windows(m: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For rows of symbols in groups (sorted), which windows of `length` columns another row of the group shares.

    Row by start column. One round for each column; a group whose rows all have the same symbol there keeps its order.
    """
    n, columns = m.shape
    never = columns + 1
    order = np.arange(n)
    start = np.zeros(n, np.int64)  # where the string shared with the row before begins
    first = np.concatenate([[True], group[1:] != group[:-1]])
    start[first] = never
    hit = np.zeros((n, columns - length + 1), bool)
    last_of = np.concatenate([first[1:], [True]])
    for k in range(columns):
        symbol = m[order, k]
        differs = np.concatenate([[False], symbol[1:] != symbol[:-1]]) & ~first
        if differs.any():
            # groups stay where they are, so places and groups are the same in every order
            mixed = np.isin(group, group[differs])
            at = np.flatnonzero(mixed)
            s, g = start[at], group[at]
            key = g * 512 + symbol[at]
            move = np.argsort(key, kind="stable")
            new = key[move]
            follows = np.concatenate([[False], new[1:] == new[:-1]])
            top = _range_max(s, move[:-1][follows[1:]] + 1, move[1:][follows[1:]])
            fresh = np.where(first[at], never, k + 1)
            fresh[follows] = top
            order[at] = order[at][move]
            start[at] = fresh
        if k + 1 >= length:
            shared = start <= k + 1 - length
            rows = order[shared | (np.concatenate([shared[1:], [False]]) & ~last_of)]
            hit[rows, k + 1 - length] = True
    return hit


def _range_max(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """max(x[low..high]) for each pair, ends included, from maxima over powers of two."""
    if not len(low):
        return np.zeros(0, x.dtype)
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            table = np.maximum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        now = level == k
        out[now] = np.maximum(table[low[now]], table[high[now] + 1 - (1 << k)])
    return out


def _order_columns(length: int):
    gram = length // 2

    def solve(groups: list[pa.Table]) -> pa.RecordBatch | None:
        rows = pa.concat_tables(groups)
        group = np.repeat(np.arange(len(groups)), [t.num_rows for t in groups])
        at = rows.column("at").to_numpy()
        data, offsets = _bytes_of(rows.column("piece").combine_chunks())
        left = np.minimum(at, gram)
        size = np.diff(offsets)
        m = np.full((len(at), gram + length), 256, np.uint16)
        column = np.arange(gram + length)
        inside = (column >= (gram - left)[:, None]) & (column < (gram - left + size)[:, None])
        m[inside] = data[offsets[0] : offsets[-1]]
        lead = np.concatenate([[0], np.cumsum([t.num_rows for t in groups])[:-1]])[group]
        middle = slice(gram, 2 * gram)
        alike = (m[:, middle] == m[lead, middle]).all()
        if alike:  # no two strings share a hash here, so these columns change no order
            hit = repeated_windows(np.delete(m, np.s_[gram : 2 * gram], 1), group, length - gram)
        else:
            hit = repeated_windows(m, group, length)
        first = np.arange(hit.shape[1])
        hit &= (first >= (gram - left)[:, None]) & (first + length <= (gram - left + size)[:, None])
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        if not len(r):
            return None
        text = rows.column("text").combine_chunks().take(pa.array(r))
        return pa.RecordBatch.from_arrays([text, pa.array(at[r] - gram + a), pa.array(at[r] - gram + b - 1 + length)], ["text", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for _, t in sorted_groups(batches, "key"):
            if n and n + t.num_rows > AT_ONCE:
                if (out := solve(held)) is not None:
                    yield out
                held, n = [], 0
            held.append(t)
            n += t.num_rows
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _split_collections(pieces: DataFrame, length: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(spans, pieces): collections of more than `largest` pieces, cut into smaller ones without losing a shared window.

    A part of a collection stands for windows that begin in columns low to high. Of pieces equal in all those windows
    one remains, and the windows of the others, and its own, are known to be repeated. A part that is still too large
    goes to two parts of half the columns each, in which pieces stay together if they are equal where all windows of
    that half overlap, as equal windows are. With one column left, pieces that stay together are equal.
    """
    gram = length // 2
    part = ["g", "low", "high"]
    rows = pieces.where(F.col("n") > largest).select(F.col("key").alias("g"), F.lit(0).alias("low"), F.lit(gram).alias("high"), "text", "at", "piece")
    spans, small = [], []
    while True:
        rows = materialize(rows, "large")
        if rows.isEmpty():
            break
        shift = F.lit(gram) - F.least(F.col("at"), F.lit(gram))  # the piece's first byte is in this column
        begin = F.greatest(F.col("low") - shift, F.lit(0))
        here = F.substring(F.col("piece"), (begin + 1).cast("int"), (F.col("high") + length - shift - begin).cast("int"))
        one = [*part, "h", "i", "missing"]
        rows = rows.withColumns({"h": F.xxhash64(here), "i": F.xxhash64(F.lit(1), here), "missing": begin - (F.col("low") - shift)})
        alike = rows.groupBy(*one).agg(F.count("*").alias("n"), F.first(F.struct("text", "at", "piece")).alias("r"))
        alike = materialize(alike, "alike")
        first, last = F.greatest(F.col("low"), shift), F.least(F.col("high"), shift + F.octet_length("piece") - length)
        again = rows.join(alike.where("n > 1").select(*one), one, "left_semi").where(last >= first)
        spans.append(again.select("text", (F.col("at") - gram + first).alias("start"), (F.col("at") - gram + last + length).alias("end")))
        sizes = alike.groupBy(*part).agg(F.count("*").alias("size")).where("size > 1")
        left = alike.join(sizes, part).select(*part, "size", "r.*")
        small.append(left.where(F.col("size") <= largest).select(F.xxhash64(*part).alias("key"), "text", "at", "size", "piece"))
        mid = F.expr("(low + high) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct((mid + 1).alias("low"), F.col("high").alias("high"))))
        left = left.where((F.col("size") > largest) & (F.col("low") < F.col("high"))).select("g", halves.alias("half"), "text", "at", "piece")
        left = left.select("g", "half.low", "half.high", "text", "at", "piece")
        fits = (F.col("high") >= shift) & (F.col("low") + length <= shift + F.octet_length("piece"))
        shared = F.substring(F.col("piece"), (F.col("high") - shift + 1).cast("int"), (F.col("low") + length - F.col("high")).cast("int"))
        rows = left.where(fits).select(F.xxhash64("g", "low", shared).alias("g"), "low", "high", "text", "at", "piece")
    join = lambda frames: reduce(DataFrame.union, frames)
    return join(spans), join(small)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        removed, runs, digest = [], [], []
        for body, spans in zip(rb.column(1), rb.column(2)):
            body, at, h = memoryview(body.as_py()), 0, hashlib.sha256()
            cut = merged([(s["start"], s["end"]) for s in spans.as_py()])
            for a, b in cut:
                h.update(body[at:a])
                at = b
            h.update(body[at:])
            removed.append(sum(b - a for a, b in cut))
            runs.append(len(cut))
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)], ["text", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    """(text, body): the bytes of each row and 16 bytes of their SHA-256, which stand for the text."""
    body = text_of().cast("binary")
    return docs.select(F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("text"), body.alias("body"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """(classes, spans): classes has text and copies; spans has text, start, end of what is repeated in distinct texts.

    Equal texts are one document here, as their copies repeat them whole. Each span is a union of windows that
    start anywhere else in the distinct texts; spans of a text may overlap.
    """
    if not 2 <= length <= _LONGEST:
        raise ValueError(f"length must be 2 to {_LONGEST} bytes")
    spark = docs.sparkSession
    ship_package(spark)
    found = _texts(docs).mapInArrow(_find_anchors(length), "text binary, keys array<long>, at array<long>")
    classes = found.groupBy("text").agg(F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("at").alias("at"))
    classes = materialize(classes, "classes")
    each = classes.select("text", F.explode(F.arrays_zip("keys", "at")).alias("a")).select("text", F.col("a.keys").alias("key"), "a.at")
    often = materialize(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    hot = F.broadcast(often.orderBy(F.desc("n"), "key").limit(COMMONEST).toDF("key", "hot"))
    told = each.join(hot, "key", "left")
    told = told.where("hot is null").drop("hot").join(often, "key").union(told.where("hot is not null").withColumnRenamed("hot", "n"))
    wanted = told.groupBy("text").agg(F.collect_list(F.struct("at", "key", "n")).alias("found"))
    bodies = _texts(docs).groupBy("text").agg(F.first("body").alias("body"))
    pieces = bodies.join(wanted, "text").select("text", "body", "found").mapInArrow(_cut_pieces(length), "key long, text binary, at long, n long, piece binary")
    n = 4 * partitions(spark)
    if often.where(F.col("n") > largest).isEmpty():
        spans = dealt_by(pieces, n, "key").mapInArrow(_order_columns(length), "text binary, start long, end long")
        return classes, materialize(spans, "spans")
    pieces = materialize(pieces, "pieces")
    known, small = _split_collections(pieces, length, largest)
    ordered = [dealt_by(p.select("key", "text", "at", "piece"), n, "key").mapInArrow(_order_columns(length), "text binary, start long, end long") for p in (pieces.where(F.col("n") <= largest), small)]
    return classes, materialize(known.union(ordered[0]).union(ordered[1]), "spans")


def without_repeats(docs: DataFrame, length: int = LENGTH, largest: int = LARGEST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) of each row of docs; repeats is 1 where anything goes, else 0.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else, in the same document or
    another, judged on the input. Null texts are empty; texts shorter than `length` keep all; rows that repeat a
    document, with or without its doc_id, are copies and lose all of a text that is long enough; null ids stay null.
    """
    classes, spans = repeated_spans(docs, length, largest)
    by_text = spans.groupBy("text").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    once = by_text.join(classes.where("copies = 1").select("text"), "text", "left_semi")
    body = text_of().cast("binary")
    rest = _texts(docs).join(once, "text").select("text", "body", "spans").mapInArrow(_strip, "text binary, n_removed long, n_spans long, kept_sha256 string")
    sha = F.sha2(body, 256)
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text_of()).cast("long").alias("n_bytes"), sha.alias("sha"))
    rows = rows.withColumn("text", F.unhex(F.substring("sha", 1, 32)))
    rows = rows.join(classes.select("text", "copies"), "text").join(rest, "text", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone | (F.col("n_removed") > 0), 1).otherwise(0).alias("repeats"),
    )
