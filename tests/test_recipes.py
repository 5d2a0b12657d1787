import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.errors import ContractError, FieldloomError, PlanError
from fieldloom.plans import recipes, yaml_graphs
from fieldloom.plans.store import ArtifactCorrupt, Store
from fieldloom.sources.json_pages import constrained, read_pages
from fieldloom.sources.rows import row

SCHEMA = row("id bigint, v bigint", "v")
CALLS = []


@recipes.source("test.numbers", 1, SCHEMA, version=lambda spark, n: f"n={n}")
def numbers(spark, n):
    CALLS.append(("numbers", n))
    return spark.range(n).select("id", (F.col("id") * 2).alias("v"))


@recipes.source("test.unversioned", 1, SCHEMA)
def unversioned(spark):
    return spark.range(2).select("id", F.lit(None).cast("long").alias("v"))


@recipes.step("test.above", 1)
def above(rows, least):
    CALLS.append(("above", least))
    return rows.where(F.col("id") >= least)


@recipes.step("test.joined", 1)
def joined(rows, times):
    return rows.withColumn("v", F.col("v") * times)


@recipes.dataset("test.kept", 1, SCHEMA, keys=["id"], order=["id"], rules={"v_even": "v % 2 = 0"})
def kept(n, least=0):
    return above(rows=numbers(n=n), least=least)


@recipes.workflow("test.both", 1)
def both(n):
    first = kept(n=n)
    return {"all": first, "late": joined(rows=first, times=numbers(n=1).value("id", int))}


def ids(df):
    return [r.id for r in df.collect()]


def test_run_plan_and_reuse(spark, tmp_path):
    store, target = Store(spark, f"file://{tmp_path}"), kept(n=5, least=2)
    assert [p["kind"] for p in recipes.plan(target)] == ["source", "step", "dataset"]
    assert set(recipes.inspect(target, store).values()) == {"compute"}
    CALLS.clear()
    seen = []
    assert ids(recipes.run(target, spark, store, observe=seen.append)) == [2, 3, 4]
    assert [e["event"] for e in seen] == ["run_started", "node_stored", "node_stored", "node_stored", "run_succeeded"]
    assert len(CALLS) == 2 and set(recipes.inspect(target, store).values()) == {"stored"}
    assert ids(recipes.run(kept(n=5, least=2), spark, store)) == [2, 3, 4] and len(CALLS) == 2
    assert ids(recipes.run(target, spark, store, recompute=["test.above@1"])) == [2, 3, 4] and CALLS[2:] == [("above", 2)]
    assert ids(recipes.run(kept(n=5, least=3), spark, store)) == [3, 4] and CALLS[3:] == [("above", 3)]
    got = recipes.run(both(n=3), spark)
    assert ids(got["all"]) == [0, 1, 2] and {r.v for r in got["late"].collect()} == {0}
    assert recipes.inspect(unversioned(), store) == {unversioned().label: "uncacheable"}


def test_failures_name_node_and_kind(spark, tmp_path):
    @recipes.dataset("test.odd", 1, SCHEMA, keys=["id"], rules={"v_odd": "v % 2 = 1"})
    def odd(n):
        return numbers(n=n)

    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(recipes.RunError) as e:
        recipes.run(odd(n=2), spark, store)
    assert e.value.category == "contract" and e.value.node.startswith("test.odd@1")
    runs = store.list_runs().collect()
    assert [(r.run_id, r.state) for r in runs] == [(e.value.run_id, "failed")]
    CALLS.clear()
    with pytest.raises(recipes.RunError):
        recipes.run(odd(n=2), spark, store)  # goes on from the stored source
    assert not CALLS
    for bad in (lambda: recipes.run(kept(n=1), spark, checkpoints="some"), lambda: recipes.plan(above(rows=object(), least=1)) or above(rows=object(), least=1).key, lambda: recipes.step("test.above", 1)(numbers.fn)):
        with pytest.raises(PlanError):
            bad()


def test_store_maintenance(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    recipes.run(kept(n=4), spark, store, checkpoints="outputs_only")
    (run,) = store.list_runs().collect()
    (node,) = store.inspect_run(run.run_id).collect()
    f = node.detail
    assert store.get(f, check_rows=True).count() == store.manifest(f)["rows"] == 4
    assert store.manifest(f)["quality"] == ["row_contract", "candidate_key_uniqueness", "deterministic_order"]
    store.export(f, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    assert store.plan_prune()["objects"] == []
    store.retire_run(run.run_id)
    store.pin(f)
    assert store.plan_prune()["objects"] == []
    store.unpin(f)
    planned = store.plan_prune()
    assert planned["objects"] == [f]
    store.retain_run(run.run_id)
    with pytest.raises(FieldloomError):
        store.execute_prune(planned)
    store.retire_run(run.run_id)
    spark.range(1).write.parquet(f"file://{tmp_path}/objects/left")
    orphans = store.plan_orphans()
    assert orphans["objects"] == ["left"] and store.clean_orphans(orphans) == 1
    spark.range(3).select("id", F.col("id").alias("v")).write.mode("overwrite").parquet(f"file://{tmp_path}/objects/{f}")
    with pytest.raises(ArtifactCorrupt):
        store.get(f, check_rows=True)
    assert store.execute_prune(planned) == 1 and not store.has(f) and store.names("objects") == []


YAML = """
parameters: [n]
nodes:
  base: {recipe: test.numbers@1, arguments: {n: {parameter: n}}}
  top: {recipe: test.above@1, arguments: {rows: {node: base}, least: {literal: 1}}}
output: top
"""


def test_yaml(spark):
    node = yaml_graphs.load(YAML, {"n": 3})
    assert node.key == above(rows=numbers(n=3), least=1).key and ids(recipes.run(node, spark)) == [1, 2]
    bad = [
        (YAML, {}), (YAML.replace("test.above@1", "test.none@1"), {"n": 1}), (YAML.replace("output: top", "output: &a top"), {"n": 1}),
        (YAML.replace("{node: base}", "{node: top}"), {"n": 1}), (YAML + "output: base\n", {"n": 1}), (YAML.replace("{literal: 1}", "{literal: !!int 1}"), {"n": 1}),
        ("nodes: {}\noutput: " + "[" * 40 + "]" * 40, {}), ("a: [", {}), (YAML + "#" * 2**20, {"n": 1}),
    ]
    for text, given in bad:
        with pytest.raises(PlanError):
            yaml_graphs.load(text, given)


def test_json_pages(spark, tmp_path):
    schema = T.StructType([*row("home_team string, start_date timestamp, total_opportunities bigint", "start_date"), T.StructField("in_list", T.ArrayType(T.StructType().add("the_id", "long")), True)])

    def page(body):
        (tmp_path / "p.json").write_text(body if isinstance(body, str) else json.dumps(body))
        return read_pages(spark, f"file://{tmp_path}/p.json", schema, odd={"total_opportunities": "totalOpportunies"})

    rows = [{"homeTeam": "b", "startDate": "2024-01-02T03:04:05.000Z", "totalOpportunies": 1, "inList": [{"theId": 7}]}, {"homeTeam": "a", "totalOpportunies": 2}]
    got = page(rows).orderBy("source_ordinal").collect()
    assert [(r.home_team, r.total_opportunities, r.source_ordinal) for r in got] == [("b", 1, 0), ("a", 2, 1)]
    assert got[0].in_list[0].the_id == 7 and str(got[0].start_date) == "2024-01-02 03:04:05" and got[1].start_date is None
    assert page([]).count() == 0
    for bad in ([{**rows[0], "more": 1}], [{"homeTeam": None, "totalOpportunies": 1}], "[{", [{**rows[0], "totalOpportunies": "x"}]):
        with pytest.raises(Exception):  # noqa: B017
            page(bad).collect()
    (tmp_path / "s.json").write_text('["x", "y"]')
    assert [r.category for r in read_pages(spark, f"file://{tmp_path}/s.json", row("category string"), shape="scalars").orderBy("source_ordinal").collect()] == ["x", "y"]
    (tmp_path / "o.json").write_text('{"homeTeam": "q"}')
    assert [r.home_team for r in read_pages(spark, f"file://{tmp_path}/o.json", row("home_team string"), shape="object").collect()] == ["q"]
    with pytest.raises(ContractError):
        constrained(spark.range(3), {"small": "id < 2"})
