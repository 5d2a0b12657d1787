"""Stored results: Parquet objects named by fingerprints, each with a manifest, and a ledger of runs. Any path Spark can write."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import checks
from fieldloom.errors import ContractError, FieldloomError
from fieldloom.operators.state import latest_per_key, prunable
from fieldloom.schema import conform, schema_digest

PART_ROWS = 250_000
#: Control values are JSON of so many bytes at most.
JSON_BYTES = 32 * 1024 * 1024
_LEDGER = "kind string, subject string, run_id string, state string, detail string, at bigint"


class ArtifactCorrupt(FieldloomError):
    """A stored object doesn't agree with its manifest."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def names(self, folder: str) -> list[str]:
        fs, p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_json(self, path: str, value) -> None:
        """Canonical JSON, whole or not at all: written beside its place and renamed into it."""
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
        if len(text.encode()) > JSON_BYTES:
            raise ContractError("a control value is too large")
        beside = f"{path}.new"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(beside)
        self.delete(path)
        fs, p = self._path(beside)
        fs.rename(p, self._path(path)[1])

    def read_json(self, path: str):
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    # objects

    def has(self, fingerprint: str) -> bool:
        return self.exists(f"{self.root}/manifests/{fingerprint}")

    def manifest(self, fingerprint: str) -> dict:
        return self.read_json(f"{self.root}/manifests/{fingerprint}")

    def put(self, df: DataFrame, fingerprint: str, *, recipe: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
        """Write, check the key on what was written, then write the manifest; without a manifest there is no object."""
        path = f"{self.root}/objects/{fingerprint}"
        if order:
            df = df.orderBy(*[F.asc_nulls_last(c) for c in order])
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", PART_ROWS).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        if keys:
            checks.keys_unique(back, keys)
        evidence = ["row_contract"] + ["candidate_key_uniqueness"] * bool(keys) + ["deterministic_order"] * bool(order)
        self.write_json(
            f"{self.root}/manifests/{fingerprint}",
            {"recipe": recipe, "schema": df.schema.jsonValue(), "schema_digest": schema_digest(df.schema), "rows": back.count(), "keys": list(keys), "order": list(order), "quality": evidence},
        )
        return back

    def get(self, fingerprint: str, *, check_rows: bool = False) -> DataFrame:
        """The object's rows. The schema must have the manifest's digest; with check_rows the count and key are checked too."""
        m = self.manifest(fingerprint)
        schema = T.StructType.fromJson(m["schema"])
        if schema_digest(schema) != m["schema_digest"]:
            raise ArtifactCorrupt(f"{fingerprint}: the schema isn't the one of the digest")
        df = self.spark.read.parquet(f"{self.root}/objects/{fingerprint}")
        try:
            df = conform(df, schema)
            if check_rows and m["keys"]:
                checks.keys_unique(df, m["keys"])
        except ContractError as e:
            raise ArtifactCorrupt(f"{fingerprint}: {e}") from e
        if check_rows and df.count() != m["rows"]:
            raise ArtifactCorrupt(f"{fingerprint}: the number of rows differs from the manifest's")
        return df

    def export(self, fingerprint: str, path: str) -> None:
        """One Parquet file in a folder that appears whole. For results that one task can hold; others keep their parts."""
        self.get(fingerprint).coalesce(1).write.option("compression", "zstd").parquet(f"{path}.new")
        fs, p = self._path(f"{path}.new")
        if not fs.rename(p, self._path(path)[1]):
            raise FieldloomError(f"{path} is taken")

    # ledger

    def note(self, kind: str, subject: str, run_id: str, state: str, detail: str = "") -> None:
        row = (kind, subject, run_id, state, detail, time.time_ns())
        self.spark.createDataFrame([row], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def ledger(self) -> DataFrame:
        path = f"{self.root}/ledger"
        return self.spark.read.schema(_LEDGER).parquet(path) if self.exists(path) else self.spark.createDataFrame([], _LEDGER)

    def latest(self, kind: str) -> DataFrame:
        """The last state of each subject of a run."""
        return latest_per_key(self.ledger().where(F.col("kind") == kind), ["subject", "run_id"], ["at"])

    def list_runs(self) -> DataFrame:
        return self.latest("run").select("run_id", "state", "detail", "at").orderBy("at")

    def inspect_run(self, run_id: str) -> DataFrame:
        """The last state of each node of a run; detail is the fingerprint."""
        return self.latest("node").where(F.col("run_id") == run_id).select("subject", "state", "detail", "at").orderBy("at")

    def retain_run(self, run_id: str) -> None:
        self.note("retention", run_id, run_id, "retained")

    def retire_run(self, run_id: str) -> None:
        self.note("retention", run_id, run_id, "retired")

    def pin(self, fingerprint: str) -> None:
        self.note("pin", fingerprint, "", "pinned")

    def unpin(self, fingerprint: str) -> None:
        self.note("pin", fingerprint, "", "unpinned")

    def _stored(self, folder: str, also: str = "") -> DataFrame:
        have = set(self.names(folder)) - (set(self.names(also)) if also else set())
        return self.spark.createDataFrame([(x,) for x in sorted(have)], "fingerprint string")

    def plan_prune(self) -> dict:
        """Objects that no run refers to but retired ones, and that aren't pinned; with a digest for execute_prune."""
        retired = self.latest("retention").where("state = 'retired'").select("run_id")
        used = self.latest("node").join(retired, "run_id", "left_anti").select(F.col("detail").alias("fingerprint")).distinct()
        pinned = self.latest("pin").where("state = 'pinned'").select(F.col("subject").alias("fingerprint"))
        return _planned(r.fingerprint for r in prunable(self._stored("manifests"), ["fingerprint"], used, pinned).collect())

    def plan_orphans(self) -> dict:
        """Objects without a manifest: what an interrupted write left."""
        return _planned(r.fingerprint for r in self._stored("objects", "manifests").collect())

    def execute_prune(self, plan: dict) -> int:
        return self._execute(plan, self.plan_prune())

    def clean_orphans(self, plan: dict) -> int:
        return self._execute(plan, self.plan_orphans())

    def _execute(self, plan: dict, now: dict) -> int:
        if plan != now:
            raise FieldloomError("the store has changed since the plan was made")
        for f in plan["objects"]:
            self.delete(f"{self.root}/manifests/{f}")
            self.delete(f"{self.root}/objects/{f}")
            self.note("object", f, "", "deleted")
        return len(plan["objects"])


def _planned(objects) -> dict:
    objects = sorted(objects)
    return {"objects": objects, "digest": hashlib.sha256("\n".join(objects).encode()).hexdigest()}
