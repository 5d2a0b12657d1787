"""Toxicity: a factorization machine over hashed terms, fitted on a bounded sample of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import materialize, ship_package, text_of

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 20_000
#: Terms that the model keeps, and the length of a term's factor.
FEATURES, FACTORS = 512, 4
#: A term is kept if so many sampled documents hold it.
LEAST_DOCS = 4
FOLDS = 5
#: Beside each word, its beginnings of so many letters are terms: they stand for all inflections of a stem.
STEMS = (4, 5)
_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> np.ndarray:
    """The 64-bit hashes of the distinct lower-cased words of the whole text, and of their stems, sorted."""
    from xxhash import xxh64_intdigest

    words = set(_WORD.findall(text.lower()))
    words.update(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))
    return np.unique(np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of present terms of their factors' products)."""

    ids: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: str) -> float:
        if not len(self.ids):
            return _sigmoid(self.bias)
        found = terms(text)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        at = at[self.ids[at] == found]
        v = self.factors[at]
        return _sigmoid(self.bias + self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum()))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = 40, seed: int = 7) -> Machine:
    """Fit on hashed terms of documents. Without both labels the bias alone is fitted, to the share of ones."""
    n, ones = len(labels), int(labels.sum())
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else -10.0
    none = Machine(np.zeros(0, np.uint64), prior, np.zeros(0), np.zeros((0, factors)))
    if not ones or ones == n:
        return none
    term, at = np.unique(np.concatenate(rows), return_inverse=True)
    who = np.repeat(np.arange(n), [len(r) for r in rows])
    df, df1 = np.bincount(at, minlength=len(term)).astype(float), np.bincount(at, weights=labels[who], minlength=len(term))
    want = df * ones / n
    chi = np.where(df >= min(LEAST_DOCS, ones), (df1 - want) ** 2 * n / np.maximum(want * (n - df), 1e-9), 0)  # of the 2 x 2 table, up to a constant
    best = np.sort(np.argsort(-chi, kind="stable")[: min(features, int((chi > 0).sum()))])
    if not len(best):
        return none
    place = np.full(len(term), -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    kept = place[at] >= 0
    x[who[kept], place[at][kept]] = 1
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    p = [np.array([prior], np.float32), np.zeros(len(best), np.float32), rng.normal(0, 0.05, (len(best), factors)).astype(np.float32)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    shrink, step, t = (0.0, 1e-4, 1e-3), 0.03, 0
    for epoch in range(epochs):
        for b in np.array_split(rng.permutation(n), max(1, n // 256)):
            xb = x[b]
            xv = xb @ p[2]
            z = p[0] + xb @ p[1] + 0.5 * ((xv**2).sum(1) - (xb @ p[2] ** 2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            g = [np.array([e.sum()], np.float32), xb.T @ e, xb.T @ (e[:, None] * xv) - (xb.T @ e)[:, None] * p[2]]
            t += 1
            for k in range(3):
                g[k] = g[k] + shrink[k] * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - step / (1 + epoch / 8) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(term[best], float(p[0][0]), p[1].astype(float), p[2].astype(float))


def held_out():
    """True for the documents whose labels the model never sees: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        found = pa.array([terms(t.as_py()).view(np.int64) for t in rb.column(2)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), found], ["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Machine:
    """Fit on at most `sample` labelled rows outside the held-out fold. A doc_id labelled more than once counts as its largest label.

    Terms are chosen on the cluster, by the same measure as in fit_machine; the driver gets the chosen terms of each
    sampled row. A doc_id with several texts gives one example, that with the least sequence of term hashes. Equal sets
    of terms count once, so a group of copies is one example.
    """
    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(known), "doc_id")  # `sample` labels at most
    rows = rows.select("doc_id", "toxic", "text").mapInArrow(_hashed, "doc_id long, toxic int, terms array<long>")
    rows = rows.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.first("toxic").alias("toxic"))
    rows = materialize(rows.groupBy("terms").agg(F.max("toxic").alias("toxic")), "sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    best = []
    if 0 < ones < n:
        each = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("df1"))
        each = each.where(F.col("df") >= min(LEAST_DOCS, ones)).withColumn("want", F.col("df") * ones / n)
        chi = (F.col("df1") - F.col("want")) ** 2 / F.greatest(F.col("want") * (n - F.col("df")), F.lit(1e-9))
        best = [r.term for r in each.orderBy(chi.desc(), "term").limit(features).collect()]
    chosen = F.array(*map(F.lit, best)) if best else F.array().cast("array<bigint>")
    got = rows.select("toxic", F.array_intersect("terms", chosen).alias("terms")).collect()  # `sample` rows at most
    got = sorted((r.toxic, r.terms) for r in got)
    return fit_machine([np.sort(np.array(t, np.int64).view(np.uint64)) for _, t in got], np.array([y for y, _ in got], np.int64))


#: Words whose terms a worker remembers, at most, and their longest.
REMEMBERED, LONGEST = 200_000, 32


class Scorer:
    """Scores batches of texts with a machine. Of each different word the terms are looked up once, not once a text."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {int(h): k for k, h in enumerate(machine.ids)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> tuple[int, ...]:
        from xxhash import xxh64_intdigest

        forms = [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]
        found = (self.place.get(xxh64_intdigest(f.encode("utf-8", "surrogatepass"))) for f in forms)
        got = tuple(k for k in found if k is not None)
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = got
        return got

    def present(self, text: str) -> set[int]:
        out: set[int] = set()
        known = self.words.get
        for w in set(_WORD.findall(text.lower())):
            t = known(w)
            if t is None:
                t = self._terms(w)
            if t:
                out.update(t)
        return out

    def scores(self, texts) -> np.ndarray:
        m = self.machine
        each = [sorted(self.present(t)) for t in texts]
        who = np.repeat(np.arange(len(each)), [len(e) for e in each])
        at = np.array([k for e in each for k in e], np.int64)
        z = m.bias + np.bincount(who, m.weights[at], len(each))
        for f in range(m.factors.shape[1]):
            v = m.factors[at, f]
            z += 0.5 * (np.bincount(who, v, len(each)) ** 2 - np.bincount(who, v * v, len(each)))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scorer(machine: Machine):
    """A column function: text to score."""
    held: list[Scorer] = []

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not held:
            held.append(Scorer(machine))
        return pd.Series(held[0].scores(text))

    return lambda column="text": score(text_of(column))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, from the whole text alone.

    Null and empty texts score as a document without terms. Rows that repeat a doc_id score each by its own text;
    a null doc_id is scored and not held out. Without labels, or with one label only, the score is the share of
    ones, smoothed, and near 0 if there are none. An empty table gives no rows.
    """
    score = scorer(train(docs, labels))
    out = docs.select(F.col("doc_id"), held_out().alias("held_out"), score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't call toxic."""
    score = scorer(train(docs, labels))
    return docs.withColumn("_score", score()).where("_score < 0.5").drop("_score")
