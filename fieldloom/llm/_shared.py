"""What the corpus operators share: shipping code to executors, cutting lineage, streaming sorted groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
#: Rows and bytes in an Arrow batch: a batch of Spark's default 10,000 rows of long texts takes hundreds of megabytes in the
#: JVM's buffers and again in Python. Set where the session hasn't chosen otherwise.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_shipped: dict[str, bool] = {}
_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that Python workers can import it anywhere; bound Arrow batches."""
    sc = spark.sparkContext
    for name, default, own in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="fieldloom-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/fieldloom_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(archive)
    _shipped[sc.applicationId] = True


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="fieldloom-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/fieldloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Yield (key, rows) for batches sorted by whole-number keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for rb in batches:
        if not rb.num_rows:
            continue
        k = np.stack([rb.column(rb.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            this = tuple(k[a].tolist())
            if current is not None and this != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = this
            held.append(rb.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def dealt_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a key together and in order, in n partitions."""
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def fold_links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs (i, j) into label, where label[x] is the smallest index x is known to reach."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def text_of(column: str = "text"):
    """Null texts are empty ones."""
    return F.coalesce(F.col(column), F.lit(""))


def deal(frame: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that no batch on the way back to the JVM is long."""
    for k in range(0, frame.num_rows, rows):
        yield frame.slice(k, rows)
