import pytest
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import ContractError, IdentityAmbiguous, IdentityNotFound, TransformError
from fieldloom.functions.text import folded
from fieldloom.operators import columns, joins, nested, state
from fieldloom.schema import conform, schema_digest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_select_and_rename(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert columns.select_columns(df, columns=["c", "a"]).columns == ["c", "a"]
    assert rows(columns.rename_columns(df, mapping={"a": "b", "b": "a"})) == [(1, "x", 2.0)]
    for bad in (lambda: columns.select_columns(df, columns=["a", "a"]), lambda: columns.select_columns(df, columns=["z"]), lambda: columns.rename_columns(df, mapping={"a": "c"}), lambda: columns.rename_columns(df, mapping={})):
        with pytest.raises(TransformError):
            bad()


def test_strict_casts(spark):
    df = spark.createDataFrame([(2.0, "7"), (None, None)], "d double, s string")
    assert rows(columns.strict_cast_columns(df, columns={"d": "int64", "s": "int64"})) == [(2, 7), (None, None)]
    for value in (1.5, 1e30):
        with pytest.raises(TransformError):
            columns.strict_cast_columns(spark.createDataFrame([(value,)], "d double"), columns={"d": "int64"})
    with pytest.raises(TransformError):
        columns.strict_cast_columns(spark.createDataFrame([("x",)], "s string"), columns={"s": "int64"})


def test_sort_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 9)], "i int, v int")
    assert [r.i for r in columns.sort_rows(df, by=["v"], descending=True, ordinal="i").collect()] == [4, 2, 3, 1]
    assert [r.i for r in columns.sort_rows(df, by=["v"], nulls_last=False, ordinal="i").collect()] == [1, 2, 3, 4]


def test_explode_policies(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "k int, v array<string>")
    drop = {"null_list": "drop", "empty_list": "drop"}
    assert rows(nested.explode_list(df, field="v", null_element="drop", ordinal_field="n", **drop)) == [(1, "a", 0), (1, "b", 2)]
    out = nested.explode_list(df, field="v", mode="outer", null_list="emit_null", empty_list="emit_null", null_element="keep", ordinal_field="n", ordinal_start=1)
    assert rows(out) == sorted([(1, "a", 1), (1, None, 2), (1, "b", 3), (2, None, None), (3, None, None)], key=str)
    for bad in ({"mode": "outer", "null_list": "drop"}, {"null_list": "emit_null"}, {**drop}, {"null_list": "error", "empty_list": "drop", "null_element": "keep"}):
        with pytest.raises(TransformError):
            nested.explode_list(df, field="v", **bad).collect()
    assert tuple(nested.explode_diagnostics(df, field="v").first()) == (3, 3, 1, 1, 1)


def test_structs_and_paths(spark):
    df = spark.createDataFrame([(1, (2, [3, 4])), (5, None)], "k int, s struct<a:int,b:array<int>>")
    assert rows(nested.flatten_struct(df, field="s", fields=["a", "b"], prefix="s_", null_struct="null_fields")) == sorted([(1, 2, [3, 4]), (5, None, None)], key=str)
    with pytest.raises(TransformError):
        nested.flatten_struct(df, field="s", fields=["a", "b"])
    with pytest.raises(TransformError):
        nested.flatten_struct(df, field="s", fields=["a"], null_struct="null_fields")
    assert rows(df.select(nested.nested_value("s", path=["b", -1], nulls="return_null"))) == [(4,), (None,)]
    with pytest.raises(TransformError):
        nested.require_one(df)


def test_coverage_joins(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    some = spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows(joins.enrich_left(base, some, ["k"], coverage="c")) == [(1, "x", "present"), (2, None, "empty")]
    twice, beyond = some.union(some), spark.createDataFrame([(9, "y")], "k int, v string")
    for bad in (lambda: joins.enrich_left(base, twice, ["k"], coverage="c"), lambda: joins.enrich_left(base, beyond, ["k"], coverage="c"), lambda: joins.enrich_left(base, some, ["k"], coverage="c", partial="error"), lambda: joins.require_complete(base, some, ["k"])):
        with pytest.raises(ContractError):
            bad()
    assert joins.enrich_left(base, beyond, ["k"], coverage="c", outside="ignore").count() == 2
    assert rows(joins.outer_union(some, beyond, ["k"], status="s")) == [(1, "x", "left_only"), (9, "y", "right_only")]


def test_range_join_needs_one(spark):
    base = spark.createDataFrame([(1, 2005)], "k int, y int")
    ranges = spark.createDataFrame([(1, 2000, 2004, "a"), (1, 2005, None, "b")], "k int, lo int, hi int, v string")
    args = dict(value="y", start="lo", end="hi", id_columns=["k", "y"])
    assert rows(joins.range_one(base, ranges, ["k"], **args)) == [(1, 2005, 2005, None, "b")]
    for r in (ranges.where("lo < 2005"), ranges.union(ranges)):
        with pytest.raises(ContractError):
            joins.range_one(base, r, ["k"], **args)


def test_state(spark):
    o = spark.createDataFrame([(1, 2, 10, "s", ("unobserved", "x")), (1, 1, 5, "s", ("known", None)), (1, 0, 9, "s", ("known", "y"))], "k int, a int, t int, src string, f struct<state:string,value:string>")
    assert rows(state.merge_observations(o, ["k"], ["f"], authority="a", observed_at="t", source="src")) == [(1, None, 5, 10)]
    e = spark.createDataFrame([(1, "Ohio  State", ["OSU"]), (2, "Oregon State", ["osu", ""])], "id int, name string, al array<string>")
    index = state.name_index(e, entity_id="id", name="name", aliases="al")
    assert state.resolve_one(index, " ohio state ") == 1
    with pytest.raises(IdentityAmbiguous):
        state.resolve_one(index, "OSU")
    with pytest.raises(IdentityNotFound):
        state.resolve_one(index, "x")
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, first_seen_at int")
    new = spark.createDataFrame([(1, "b", 9), (2, "c", 9)], "k int, v string, first_seen_at int")
    assert rows(state.upsert(old, new, ["k"])) == [(1, "b", 1), (2, "c", 9)]
    assert folded("Straße") == folded("STRASSE") and folded("ﬁx", True) == "fix"


def test_contracts(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert conform(df.select("b", "a"), df.schema).columns == ["a", "b"]
    assert schema_digest(df.schema) != schema_digest(df.select("b", "a").schema)
    for bad in (df.drop("b"), df.withColumn("c", F.lit(1)), df.withColumn("a", F.lit("1"))):
        with pytest.raises(ContractError):
            conform(bad, df.schema)
    with pytest.raises(ContractError):
        checks.keys_unique(df.union(df), ["a"])
    with pytest.raises(ContractError):
        checks.keys_unique(df.withColumn("a", F.lit(None).cast("int")), ["a"])


def test_text_casts_take_plain_forms_only(spark):
    from fieldloom.errors import TransformError
    from fieldloom.operators import columns

    good = {"int64": ["12", "-3"], "float64": ["1.5", "2", "1e3"], "boolean": ["true"], "date32": ["2024-01-02"], "timestamp[us]": ["2024-01-02 03:04:05"], "timestamp[us, UTC]": ["2024-01-02T03:04:05Z"]}
    bad = {"int64": [" 12 ", "1.0"], "float64": ["1.5d", " 1"], "boolean": ["yes", "1"], "date32": ["2024", "2024-1-2"], "timestamp[us]": ["2024-01-02"], "timestamp[us, UTC]": ["2024-01-02 03:04:05"]}
    kinds = list(good)
    d = spark.createDataFrame([tuple(good[k][0] for k in kinds), tuple(good[k][-1] for k in kinds)], [f"a.{k}" for k in range(len(kinds))])
    out = columns.strict_cast_columns(d, columns={f"a.{k}": t for k, t in enumerate(kinds)})
    assert out.count() == 2 and columns.rename_columns(columns.select_columns(out, columns=["a.0"]), mapping={"a.0": "x.y"}).columns == ["x.y"]
    for k, texts in bad.items():
        for text in texts:
            with pytest.raises(TransformError):
                columns.strict_cast_columns(spark.createDataFrame([(text,)], "x string"), columns={"x": k})


def test_deep_ancestry_and_folding(spark):
    from fieldloom.functions.text import casefolded, identity_text
    from fieldloom.operators import state

    chain = spark.range(400).selectExpr("id as node", "if(id > 0, id - 1, null) as parent")
    assert state.ancestry(chain, node="node", parent="parent", start=350).count() == 351
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_fieldloom")]
    words = ["Straße", "ΣΊΣΥΦΟΣ", "İstanbul", "ılık", "ﬁn", "ſo", "ᾼ", "ẞ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", casefolded(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in got} == {w: w.casefold() for w in words}
    assert spark.range(1).select(identity_text(F.lit(" A\u00a0\t B\x1c "))).first()[0] == "a b"


def test_first_sight_needs_authority(spark):
    from fieldloom.operators import state

    rows = [(1, 0, 5, "a", ("known", 1)), (1, 2, 9, "b", ("known", 2)), (2, 0, 4, "a", ("known", 3))]
    d = spark.createDataFrame(rows, "k long, auth int, at int, src string, f struct<state: string, value: int>")
    got = state.merge_observations(d, ["k"], ["f"], authority="auth", observed_at="at", source="src")
    assert {r.k: (r.f, r.first_seen_at) for r in got.collect()} == {1: (2, 9), 2: (3, 4)}
