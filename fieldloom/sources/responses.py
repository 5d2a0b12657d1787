"""Stored responses: bodies by request, a record of each state of them, and when they must be fetched again."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.errors import NoContent, ResponseCorrupt, TransportError
from fieldloom.functions import freshness
from fieldloom.operators.state import latest_per_key
from fieldloom.schema import schema_digest
from fieldloom.sources import transport
from fieldloom.sources.json_pages import read_pages

MODES = ("default", "refresh", "bypass", "local_only")
#: Bodies are of so many bytes at most.
MOST_BYTES = 32 * 1024 * 1024
_RECORD = "key string, path string, parameters string, digest string, contract string, etag string, last_modified string, fetched_at timestamp, fresh_until timestamp, retained_until timestamp, state string, at bigint"


def request_key(path: str, parameters: Mapping) -> str:
    """SHA-256 of the canonical request."""
    return hashlib.sha256(json.dumps([path, dict(parameters)], sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


class Responses:
    """root/bodies/<key>/<digest> holds a body, root/records the states of all; `send` fetches, where there is one.

    Modes: default (a fresh body, else fetched, else a stale one where the failure may pass), refresh (fetched), bypass
    (fetched and not kept), local_only (kept, fresh or stale, never fetched).
    """

    def __init__(self, spark: SparkSession, root: str, send: Callable | None = None, *, mode: str = "default", clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC), budget: transport.Budget | None = None):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.root, self.send, self.mode, self.clock, self.budget = spark, root.rstrip("/"), send, mode, clock, budget
        self._once: dict[tuple, str] = {}

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def records(self) -> DataFrame:
        """The last record of each request."""
        fs, p = self._path(f"{self.root}/records")
        kept = self.spark.read.schema(_RECORD).parquet(f"{self.root}/records") if fs.exists(p) else self.spark.createDataFrame([], _RECORD)
        return latest_per_key(kept, ["key"], ["at"]).where("state = 'kept'")

    def _record(self, key: str):
        found = self.records().where(F.col("key") == key).take(1)
        return found[0] if found else None

    def _note(self, key: str, path: str, parameters: Mapping, digest: str, contract: str, answer: transport.Answer, now: dt.datetime, ttl: freshness.Ttl, state: str = "kept") -> None:
        row = (key, path, json.dumps(dict(parameters), sort_keys=True), digest, contract, answer.header("ETag"), answer.header("Last-Modified"), now, now + ttl.fresh_for, now + ttl.retain_for, state, int(now.timestamp() * 1e6))
        self.spark.createDataFrame([row], _RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/records")

    def keep(self, path: str, parameters: Mapping, body: bytes, schema: T.StructType, *, shape: str = "list", answer: transport.Answer | None = None, now: dt.datetime | None = None) -> str:
        """Store a body that reads as the schema's rows, with its times; returns where it is."""
        now = now or self.clock()
        if len(body) > MOST_BYTES:
            raise ResponseCorrupt(f"{path}: the body is too large")
        key, digest = request_key(path, parameters), hashlib.sha256(body).hexdigest()
        at = f"{self.root}/bodies/{key}/{digest}"
        self.spark.createDataFrame([(body.decode(),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\u0000").text(at)
        df = read_pages(self.spark, at, schema, shape=shape)
        facts = freshness.game_facts(df, now).first().asDict() if path == "/games" else {"n_rows": df.count()}
        ttl = freshness.ttl(path, parameters, facts.pop("n_rows"), now, **facts)
        if ttl is not None:
            self._note(key, path, parameters, digest, schema_digest(schema), answer or transport.Answer(200), now, ttl)
        return at

    def _fetch(self, path: str, parameters: Mapping, schema: T.StructType, shape: str, known, now: dt.datetime) -> str:
        if self.send is None:
            raise NoContent(f"{path}: not stored, and nothing fetches")
        headers = {}
        if known is not None and known.contract == schema_digest(schema):
            headers = {"If-None-Match": known.etag} if known.etag else {"If-Modified-Since": known.last_modified} if known.last_modified else {}
        a = transport.get(self.send, path, parameters, headers=headers, budget=self.budget)
        if a.status == 304 and known is not None:
            again = transport.Answer(304, headers={"ETag": known.etag, "Last-Modified": known.last_modified})
            self._note(known.key, path, parameters, known.digest, known.contract, again, now, freshness.Ttl(known.fresh_until - known.fetched_at, known.retained_until - known.fetched_at))
            return f"{self.root}/bodies/{known.key}/{known.digest}"
        return self.keep(path, parameters, a.body, schema, shape=shape, answer=a, now=now)

    def locate(self, path: str, parameters: Mapping, schema: T.StructType, *, shape: str = "list", now: dt.datetime | None = None, mode: str | None = None) -> str:
        """Where the request's body is, fetched first as the mode asks. A request is settled once for each of these objects."""
        mode = mode or self.mode
        key = request_key(path, parameters)
        if (key, mode) in self._once:
            return self._once[key, mode]
        now = now or self.clock()
        known = None if mode == "bypass" else self._record(key)
        # without a zone, times of a record are in the session's, as the clock's are made here
        moment = now.astimezone().replace(tzinfo=None)
        fits = known is not None and known.contract == schema_digest(schema)
        usable = fits and known.retained_until > moment
        kept = f"{self.root}/bodies/{key}/{known.digest}" if fits else ""
        if mode == "local_only":
            if not usable:
                raise NoContent(f"{path}: nothing stored that may be used")
            at = kept
        elif mode == "default" and usable and known.fresh_until > moment:
            at = kept
        else:
            try:
                at = self._fetch(path, parameters, schema, shape, known, now)
            except TransportError as e:
                if mode != "default" or not usable or not (e.status == 0 and e.retryable or e.status in (408, 429) or e.status >= 500):
                    raise
                at = kept
        self._once[key, mode] = at
        return at

    def rows(self, path: str, parameters: Mapping, schema: T.StructType, *, shape: str = "list", now: dt.datetime | None = None, mode: str | None = None) -> DataFrame:
        return read_pages(self.spark, self.locate(path, parameters, schema, shape=shape, now=now, mode=mode), schema, shape=shape)

    def version(self, path: str, parameters: Mapping) -> str | None:
        """The digest of the request's stored body; None where there is none."""
        r = self._record(request_key(path, parameters))
        return r.digest if r else None

    def reprojected(self, contract: str) -> DataFrame:
        """Records that were kept under another contract: their bodies are to be read again for what is derived from them."""
        return self.records().where(F.col("contract") != contract)

    def clean(self, now: dt.datetime | None = None) -> int:
        """Drop what is kept no longer: records first, then the bodies that no record names."""
        now = now or self.clock()
        gone = [r for r in self.records().where(F.col("retained_until") <= F.lit(now)).collect()]
        for r in gone:
            self._note(r.key, r.path, json.loads(r.parameters), r.digest, r.contract, transport.Answer(0), now, freshness.Ttl(dt.timedelta(0), dt.timedelta(0)), "dropped")
            fs, p = self._path(f"{self.root}/bodies/{r.key}")
            fs.delete(p, True)
        return len(gone)
