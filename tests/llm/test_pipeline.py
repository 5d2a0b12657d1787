"""The corpus pipeline on a small corpus with planted cases: each stage against what it must drop and keep."""

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm._shared import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 4000, n))


ITEM = "the old miller carried nine heavy sacks of flour over the stone bridge before the river rose in spring"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for k in range(1, 301):
        text = prose(k, 80)
        bad = k % 5 == 0
        if bad:
            text = text.replace(" ", f" vile{k % 3} ", 2)
        rows.append((k, text))
        labels.append((k, 1, int(bad)))
    rows += [(1001, rows[0][1]), (1002, rows[0][1] + " end"), (1003, prose(7000, 30) + " " + ITEM + " " + prose(7001, 30)), (1004, None), (1005, ""), (None, prose(8000, 40)), (1, prose(8001, 50))]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return f"file://{root}", rows


def test_stages(spark, corpus):
    sf_dir, rows = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = materialize(out, name)
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    start = [(r[0], r[1]) for r in rows]
    bad = {i for i, t in start if t and "vile" in t}
    left = seen["toxicity"]
    assert len(bad & {i for i, _ in left}) <= 0.2 * len(bad) and len(left) >= len(start) - len(bad) - 2
    ids = [i for i, _ in seen["simhash_near_dedup"]]
    assert 1001 not in ids and 1002 not in ids and ids.count(1) == 2 and None in ids and (1004 in ids) != (1005 in ids)
    assert len(ids) == len(left) - 3
    assert {i for i, _ in seen["simhash_near_dedup"]} - {i for i, _ in seen["benchmark_decontamination"]} == {1003}
    assert 0 < len(seen["mixing"]) <= len(seen["benchmark_decontamination"])
    shards = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in shards.collect()) == sorted(i or 0 for i, _ in seen["mixing"]) and {r.shard for r in shards.collect()} <= set(range(40))


def test_empty_tables(spark, corpus, tmp_path):
    sf_dir, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
