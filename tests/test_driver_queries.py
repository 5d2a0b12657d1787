import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names_and_entry(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q)
    assert __spark_entry__.entry(spark).count() > 0


def told(rows):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_core_queries_against_sql(spark):
    import duckdb

    from fieldloom.plans.driver_queries import ORACLE_SQL, QUERIES, TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wrong = {}
    for name, f in QUERIES.items():
        df = f(spark, SF)
        columns = sorted(df.columns)
        got, want = told(df.select(*columns).collect()), told(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
        if got != want:
            wrong[name] = (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:1])
    assert not wrong


def test_returns_of_one_line_number(spark, tmp_path):
    import duckdb

    from fieldloom.plans.driver_queries import ORACLE_SQL, QUERIES

    parts = spark.createDataFrame([(1, "Brand#11", "one", 10), (2, "Brand#12", "two", 40), (3, "Brand#11", "three", 5)], "p_partkey long, p_brand string, p_name string, p_size int")
    lines = [(7, 1, 2, "R"), (7, 1, 2, "R"), (7, 2, 2, "R"), (9, 2, 1, "R"), (9, 2, 1, "R"), (None, 2, 1, "R"), (None, 2, 1, "R"), (9, 3, 1, "A"), (9, None, 1, "R"), (9, 8, 1, "R")]
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["player_seasons_product"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['player_seasons_product']})").fetchall()
    assert told(got.collect()) == told(want) and {r.athlete_id: r.n_statistics for r in got.collect()} == {"1": 2, "2": 5, "3": 0}
