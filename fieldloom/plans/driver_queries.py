"""One query for each operator family over the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.functions import freshness
from fieldloom.functions.text import clock_seconds, result_state
from fieldloom.operators import columns, joins, nested, state
from fieldloom.products import seasons, team_games

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query("SELECT c_name AS c_mktsegment, c_mktsegment AS c_name, c_custkey AS customer FROM customer")
def select_rename(spark, d):
    picked = columns.select_columns(read(spark, d, "customer"), columns=["c_custkey", "c_name", "c_mktsegment"])
    return columns.rename_columns(picked, mapping={"c_name": "c_mktsegment", "c_mktsegment": "c_name", "c_custkey": "customer"})


@query("SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def strict_cast_safe(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return columns.strict_cast_columns(rows, columns={"l_linenumber": "float64", "l_quantity": "int64"})


@query("SELECT count(*) FILTER (l_discount <> trunc(l_discount)) AS lossy_discounts, count(*) FILTER (l_quantity <> trunc(l_quantity)) AS lossy_quantities FROM lineitem")
def strict_cast_violations(spark, d):
    lossy = lambda c: F.count_if(columns.loses(c, "double", "bigint"))
    return read(spark, d, "lineitem").agg(lossy("l_discount").alias("lossy_discounts"), lossy("l_quantity").alias("lossy_quantities"))


@query(
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'O') AS o_orderstatus FROM orders) "
    "ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 100"
)
def stable_sort_topk(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"), "o_totalprice")
    return columns.sort_rows(o, by=["o_orderstatus", "o_totalprice"], descending=True, ordinal="o_orderkey").limit(100)


_RESULT = "CASE WHEN {0} > {1} THEN 'win' WHEN {0} < {1} THEN 'loss' WHEN {0} = {1} THEN 'tie' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, 0 AS perspective_ordinal, l_partkey AS own_key, l_suppkey AS other_key, l_partkey - l_suppkey AS differential, {_RESULT.format("l_partkey", "l_suppkey")} AS result FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1, l_suppkey, l_partkey, l_suppkey - l_partkey, {_RESULT.format("l_suppkey", "l_partkey")} FROM lineitem"""
)
def perspective_unpivot(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    side = lambda x, y: {"own_key": x, "other_key": y, "differential": x - y, "result": result_state(x, y)}
    return nested.perspectives(read(spark, d, "lineitem"), sides=[side(a, b), side(b, a)], keep=["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL OR s IS NULL THEN 'incomplete' WHEN q > s THEN 'win' WHEN q < s THEN 'loss' ELSE 'tie' END AS result_state, abs(q - s) AS margin
FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1) AS q, CAST(nullif(l_linenumber, 3) AS DOUBLE) * 8 AS s FROM lineitem)"""
)
def derived_result(spark, d):
    q, s = F.nullif("l_quantity", F.lit(1.0)), F.nullif("l_linenumber", F.lit(3)).cast("double") * 8
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(result_state(q, s), F.lit("incomplete")).alias("result_state"), F.abs(q - s).alias("margin"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[-1] AS DOUBLE) AS last_value FROM embeddings")
def nested_element(spark, d):
    at = lambda k: nested.nested_value("embedding", path=[k], nulls="return_null").cast("double")
    return read(spark, d, "embeddings").select("vec_id", at(0).alias("first_value"), at(-1).alias("last_value"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS prop_k FROM events")
def flatten_props(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return nested.flatten_struct(e, field="props", fields=["k"], prefix="prop_", null_struct="null_fields")


#: Every document's words, and beside them a row with a null list and one with an empty list for each source.
_WORDS = """SELECT doc_id, string_split(text, ' ') AS words FROM documents
UNION ALL SELECT -1 - dense_rank() OVER (ORDER BY source), NULL FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT -1001 - dense_rank() OVER (ORDER BY source), [] FROM (SELECT DISTINCT source FROM documents)"""


def _words(spark, d):
    docs = read(spark, d, "documents")
    w = docs.select("doc_id", F.split("text", " ").alias("word"))
    source = state.with_ordinal(docs.select("source").distinct(), ["source"], name="n")  # some tens of rows
    none = source.select((F.lit(-2) - F.col("n")).alias("doc_id"), F.lit(None).cast("array<string>").alias("word"))
    empty = source.select((F.lit(-1002) - F.col("n")).alias("doc_id"), F.array().cast("array<string>").alias("word"))
    return joins.concat(w, none, empty)


@query(f"SELECT doc_id, unnest(words) AS word, CAST(unnest(range(len(words))) AS BIGINT) AS ordinal FROM ({_WORDS}) WHERE len(words) > 0")
def explode_inner(spark, d):
    return nested.explode_list(_words(spark, d), field="word", null_list="drop", empty_list="drop", null_element="keep", ordinal_field="ordinal")


@query(
    f"""SELECT doc_id, unnest(words) AS word, CAST(unnest(range(1, len(words) + 1)) AS BIGINT) AS ordinal FROM ({_WORDS}) WHERE len(words) > 0
UNION ALL SELECT doc_id, NULL, NULL FROM ({_WORDS}) WHERE words IS NULL OR len(words) = 0"""
)
def explode_outer(spark, d):
    return nested.explode_list(_words(spark, d), field="word", mode="outer", null_list="emit_null", empty_list="emit_null", null_element="keep", ordinal_field="ordinal", ordinal_start=1)


@query(
    f"""SELECT count(*) AS input_rows, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS output_rows, count(*) FILTER (words IS NULL) AS null_lists,
count(*) FILTER (len(words) = 0) AS empty_lists, CAST(0 AS BIGINT) AS null_elements FROM ({_WORDS})"""
)
def explode_diagnostics(spark, d):
    return nested.explode_diagnostics(_words(spark, d), field="word")


@query(
    """SELECT conv_id, role, text, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS BIGINT) AS role_ordinal,
CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS BIGINT) AS turn_ordinal FROM conversations"""
)
def multi_level_flatten(spark, d):
    c = read(spark, d, "conversations")
    roles = c.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    convs = roles.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "turns"))).alias("roles"))
    drop = {"null_list": "drop", "empty_list": "drop", "null_element": "keep"}
    one = nested.explode_list(convs, field="roles", ordinal_field="role_ordinal", **drop).select("conv_id", "roles.*", "role_ordinal")
    return nested.explode_list(one, field="turns", ordinal_field="turn_ordinal", **drop).select("conv_id", "role", "turns.text", "role_ordinal", "turn_ordinal")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN 'present' ELSE 'empty' END AS label_coverage FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left_coverage(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return joins.enrich_left(docs, read(spark, d, "labels"), ["doc_id"], coverage="label_coverage")


_LINE_KEY = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    f"""SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_lines, arg_min(l_partkey, row({_LINE_KEY})) AS first_part, arg_max(l_partkey, row({_LINE_KEY})) AS last_part,
CASE WHEN count(l_orderkey) > 0 THEN 'present' ELSE 'empty' END AS line_coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def enrich_collect(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *_LINE_KEY.split(", "))
    j = joins.enrich_collect(read(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], ordinal="l_linenumber", into="lines", coverage="line_coverage")
    end = lambda k: F.try_element_at("lines", F.lit(k))["l_partkey"]
    return j.select("o_orderkey", long(F.size("lines")).alias("n_lines"), end(1).alias("first_part"), end(-1).alias("last_part"), "line_coverage")


@query("SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY l_suppkey")
def universe_violations(spark, d):
    base = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return checks.outside(read(spark, d, "lineitem").select("l_suppkey"), base, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n_lines"))


@query(
    """SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, CASE WHEN count(l.doc_id) = 0 THEN 'empty' WHEN count(l.doc_id) = count(*) THEN 'complete' ELSE 'partial' END AS coverage
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source"""
)
def complete_or_empty(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    n = j.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("there").alias("n_labelled"))
    return n.withColumn("coverage", joins.coverage_of(F.col("n_labelled"), F.col("n_docs")))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate")
def context_conflicts(spark, d):
    lines, o = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query(
    """WITH s AS (SELECT user_id, event_id AS start_event, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT e.event_id, e.user_id, s.start_event FROM events e JOIN s ON s.user_id = e.user_id AND s.start_ts <= e.ts AND (s.next_ts IS NULL OR e.ts < s.next_ts)"""
)
def range_join_one(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kind = nested.bind_value(e.agg(F.min("event_type").alias("k")), "k", str)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("start_event"), F.col("ts").alias("start_ts"), F.lead("ts").over(w).alias("next_ts"))
    s = s.withColumn("last_ts", F.expr("next_ts - interval 1 microsecond")).drop("next_ts")
    first = s.groupBy("user_id").agg(F.min("start_ts").alias("first_ts"))
    base = e.join(first, "user_id").where("ts >= first_ts").select("event_id", "user_id", "ts")
    out = joins.range_one(base, s, ["user_id"], value="ts", start="start_ts", end="last_ts", id_columns=["event_id"])
    return out.select("event_id", "user_id", "start_event")


@query(
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_nationkey < 15 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_nationkey >= 10 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nation, n_customers, n_suppliers, CASE WHEN c.k IS NULL THEN 'suppliers_only' WHEN s.k IS NULL THEN 'customers_only' ELSE 'both' END AS status FROM c FULL JOIN s ON c.k = s.k"""
)
def outer_union_status(spark, d):
    c = read(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = read(spark, d, "supplier").where("s_nationkey >= 10").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return joins.outer_union(c, s, ["nation"], status="status", names=("both", "customers_only", "suppliers_only"))


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_partkey) - 1 AS BIGINT) AS class_ordinal FROM part")
def class_ordinal(spark, d):
    p = read(spark, d, "part")
    out = state.with_ordinal(p, [F.nullif("p_size", F.lit(1)).asc_nulls_last(), "p_partkey"], partition=["p_brand"], name="class_ordinal")
    return out.select("p_partkey", "p_brand", "class_ordinal")


@query(
    """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS only_left,
(SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)) AS only_right"""
)
def set_equality(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).distinct()
    n = lambda x, y, c: checks.outside(x, y, ["k"]).agg(F.count("*").alias(c))
    return n(a, b, "only_left").crossJoin(n(b, a, "only_right"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1996")
def concat_partitions(spark, d):
    o = read(spark, d, "orders")
    in_year = lambda y: (F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast(o.schema["o_orderdate"].dataType)) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast(o.schema["o_orderdate"].dataType))
    return joins.concat(*[o.where(in_year(y)).select("o_orderkey", "o_custkey", "o_totalprice", F.lit(y).alias("season")) for y in range(1993, 1997)])


_NAMES = """WITH e AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), substr(n_name, 1, 1) FROM nation),
i AS (SELECT lower(trim(name)) AS norm, min(id) AS low, count(DISTINCT id) AS n FROM e GROUP BY 1),
q AS (SELECT CAST(r_regionkey AS BIGINT) AS k, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'nation', '  ' || lower(n_name) || ' ' FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'initial', substr(n_name, 1, 1) FROM nation)"""


@query(
    f"""{_NAMES} SELECT q.k, q.kind, CASE WHEN i.n = 1 THEN i.low END AS entity_id, CASE WHEN i.n = 1 THEN 'resolved' WHEN i.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution,
CAST(coalesce(i.n, 0) AS BIGINT) AS n_candidates FROM q LEFT JOIN i ON lower(trim(q.name)) = i.norm"""
)
def identity_resolution(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    e = n.select(long("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 1)).alias("aliases"))
    part = lambda df, key, kind, c: df.select(long(key).alias("k"), F.lit(kind).alias("kind"), c.alias("name"))
    q = joins.concat(part(r, "r_regionkey", "region", F.col("r_name")), part(n, "n_nationkey", "nation", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))), part(n, "n_nationkey", "initial", F.substring("n_name", 1, 1)))
    out = state.resolve_names(q, state.name_index(e, entity_id="id", name="name", aliases="aliases"), name="name")
    return out.select("k", "kind", "entity_id", "resolution", long(F.size("candidate_ids")).alias("n_candidates"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 3 AND (s_suppkey = l.l_partkey OR s_suppkey = l.l_suppkey))")
def identity_find(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.semi_any(lines, ["l_partkey", "l_suppkey"], read(spark, d, "supplier").where("s_nationkey = 3"), "s_suppkey")


@query(
    """WITH o AS (SELECT user_id, event_id, ts, event_type, value, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS authority FROM events)
SELECT user_id, arg_max(event_type, row(authority, ts, event_id)) AS kind, arg_max(value, row(authority, ts, event_id)) FILTER (value > 10) AS amount, coalesce(min(ts) FILTER (authority > 0), min(ts)) AS first_seen_at, max(ts) AS last_seen_at FROM o GROUP BY user_id"""
)
def observation_merge(spark, d):
    e = read(spark, d, "events")
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    seen = lambda c, there: F.struct(F.when(there, "known").otherwise("unobserved").alias("state"), c.alias("value"))
    o = e.select("user_id", "event_id", "ts", rank.alias("authority"), seen(F.col("event_type"), F.lit(True)).alias("kind"), seen(F.col("value"), F.col("value") > 10).alias("amount"))
    return state.merge_observations(o, ["user_id"], ["kind", "amount"], authority="authority", observed_at="ts", source="event_id")


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, d):
    return state.latest_per_key(read(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query(
    """SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber = 1) AND p_size <> 7"""
)
def prunable(spark, d):
    lines = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    out = state.prunable(p, ["p_partkey"], lines.where("l_quantity > 45"), lines.where("l_returnflag = 'R' and l_linenumber = 1"), p.where("p_size = 7"))
    return out.select("p_partkey", "p_name")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey > 0 THEN s_suppkey // 2 END AS parent FROM supplier),
up(node, parent, depth) AS (SELECT node, parent, 0 FROM e WHERE node = 77 UNION ALL SELECT e.node, e.parent, up.depth + 1 FROM up JOIN e ON e.node = up.parent WHERE up.depth < 50)
SELECT node, depth FROM up"""
)
def ancestry(spark, d):
    e = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.expr("if(s_suppkey > 0, s_suppkey div 2, null)").alias("parent"))
    return state.ancestry(e, node="node", parent="parent", start=77, limit=50)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_quality(spark, d):
    return checks.key_violations(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def catalog_counts(spark, d):
    return joins.concat(*[read(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in TABLES])


@query(
    """SELECT o_orderkey, CAST(least(CASE o_orderstatus WHEN 'O' THEN 3600 WHEN 'F' THEN 2592000 ELSE 86400 END, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 900 ELSE 604800 END,
CASE WHEN o_totalprice < 1000 THEN 300 ELSE 1209600 END) AS BIGINT) AS ttl_seconds FROM orders"""
)
def ttl_refinement(spark, d):
    of = F.when(F.col("o_orderstatus") == "O", 3600).when(F.col("o_orderstatus") == "F", 2592000).otherwise(86400)
    lately = F.when(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 900).otherwise(604800)
    small = F.when(F.col("o_totalprice") < 1000, 300).otherwise(1209600)
    return read(spark, d, "orders").select("o_orderkey", freshness.refined_seconds(of, lately, small).alias("ttl_seconds"))


@query("SELECT event_id, CAST(nullif(minute(ts), 0) * 60 + second(ts) AS BIGINT) AS clock_seconds FROM events")
def clock(spark, d):
    return read(spark, d, "events").select("event_id", long(clock_seconds(F.nullif(F.minute("ts"), F.lit(0)), F.second("ts"))).alias("clock_seconds"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)")
def scalar_bind(spark, d):
    n = read(spark, d, "nation")
    key = nested.bind_value(n.where("n_nationkey = 7"), "n_regionkey", int)
    return n.where(F.col("n_regionkey") == key).join(read(spark, d, "region").where(F.col("r_regionkey") == key), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT low, high FROM (SELECT lag(event_id) OVER w AS low, event_id AS high, lag(ts) OVER w AS before, ts FROM events WINDOW w AS (ORDER BY event_id)) WHERE before > ts")
def order_violations(spark, d):
    """Neighbours by event_id whose times run backwards."""
    return checks.disorder(read(spark, d, "events").select("event_id", "ts"), "event_id", ["ts"])


@query("SELECT d.doc_id, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_checked(spark, d):
    """An enrichment whose uniqueness and place in the base are checked within the plan."""
    labels = read(spark, d, "labels").select("doc_id", F.struct("quality", "toxic").alias("label"))
    out = joins.attach(read(spark, d, "documents").select("doc_id"), labels, ["doc_id"], into="label", outside="error")
    return out.select("doc_id", F.col("label.toxic").alias("toxic"), F.col("label").isNotNull().alias("labelled"))


@query(
    """SELECT event_id, CASE WHEN ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' THEN 'fresh' WHEN ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-15' THEN 'stale' ELSE 'expired' END AS state FROM events"""
)
def freshness_states(spark, d):
    until = lambda days: F.col("ts") + F.expr(f"interval {days} days")
    now = F.lit("2024-01-15 00:00:00").cast(read(spark, d, "events").schema["ts"].dataType)
    return read(spark, d, "events").select("event_id", freshness.state(until(1), until(7), now).alias("state"))


_GAMES = """SELECT l_orderkey * 8 + l_linenumber AS game_id, l_partkey AS home_id, l_suppkey AS away_id, CAST(l_quantity AS BIGINT) AS home_points, CAST(l_linenumber * 9 AS BIGINT) AS away_points FROM lineitem"""
_SIDES = "SELECT game_id, {place} AS perspective_ordinal, '{own}' AS home_away, {own}_id AS team_id, {other}_id AS opponent_id, {own}_points - {other}_points AS point_differential, " + _RESULT.format("{own}_points", "{other}_points") + " AS result FROM (" + _GAMES + ")"


@query(" UNION ALL ".join(_SIDES.format(place=k, own=a, other=b) for k, (a, b) in enumerate((("home", "away"), ("away", "home")))))
def team_games_product(spark, d):
    """Line items as games between their part and their supplier: both sides, by the product's own step."""
    home, away = long("l_quantity"), long(F.col("l_linenumber") * 9)
    x = {"game_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "season": F.lit(2024), "week": F.lit(1), "season_type": F.lit("regular"), "start_date": F.col("l_shipdate"), "completed": F.lit(True)}
    x |= {c: F.lit(True) for c in ("neutral_site", "conference_game")} | {c: F.lit("x") for c in ("venue_id", "venue")}
    for side, key, points in (("home", "l_partkey", home), ("away", "l_suppkey", away)):
        x |= {f"{side}_id": F.col(key), f"{side}_team": F.col(key).cast("string"), f"{side}_conference": F.lit("c"), f"{side}_classification": F.lit("fbs"), f"{side}_points": points}
    x |= {"total_points": home + away, "margin": F.abs(home - away), "result_state": F.when(home > away, "home_win").when(home < away, "away_win").otherwise("tie")}
    x |= {"winner_id": F.when(home > away, F.col("l_partkey")).when(home < away, F.col("l_suppkey"))}
    games = read(spark, d, "lineitem").select(*[c.alias(n) for n, c in x.items()])
    # a part and a supplier may have one number: such a game's winner isn't told by id, so it is left to the side's points
    out = team_games.sides(games)
    same = F.col("team_id") == F.col("opponent_id")
    result = F.when(same & (F.col("point_differential") != 0), result_state(F.col("points"), F.col("opponent_points"))).otherwise(F.col("result"))
    return out.select("game_id", F.col("perspective_ordinal").cast("int").alias("perspective_ordinal"), "home_away", "team_id", "opponent_id", "point_differential", result.alias("result"))


@query(
    """SELECT 2024 AS season, c_custkey AS team_id, c_name AS team, CAST(count(*) AS BIGINT) AS n_statistics, CAST(min(o_orderkey) AS VARCHAR) AS first_statistic, max(o_totalprice) AS best,
CASE WHEN c_acctbal > 0 THEN 'present' END AS state FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey, c_name, c_acctbal"""
)
def team_seasons_product(spark, d):
    """Customers in credit that have orders as teams, their orders as statistics and their best order as advanced metrics; ratings from the customers themselves."""
    o = read(spark, d, "orders")
    c = read(spark, d, "customer").where("c_acctbal > 0").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    record = {n: F.lit(None).cast("string") for n in seasons._RECORD} | {"conference": F.lit("c")}
    records = c.select(F.lit(2024).alias("year"), F.col("c_custkey").alias("team_id"), F.col("c_name").alias("team"), *[x.alias(n) for n, x in record.items()])
    named = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("team")), "o_custkey")
    stats = named.select(F.lit(2024).alias("season"), "team", F.lit("c").alias("conference"), F.col("o_orderkey").cast("string").alias("stat_name"), F.col("o_totalprice").alias("stat_value"), F.col("o_orderkey").alias("source_ordinal"))
    best = named.groupBy("team").agg(F.max("o_totalprice").alias("best")).select(F.lit(2024).alias("season"), "team", "best", F.lit(0).alias("source_ordinal"))
    elo = records.select("year", "team", "conference", F.lit(0).alias("source_ordinal"))
    out = seasons.team_seasons(records, stats, best, elo_rating=elo)
    return out.select("season", "team_id", "team", long(F.size("statistics")).alias("n_statistics"), F.col("statistics")[0]["name"].alias("first_statistic"), F.col("advanced.best").alias("best"), F.col("elo_rating_coverage").alias("state"))


@query(
    """WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS athlete_id, p_brand AS team, p_name AS name FROM part WHERE p_size <= 30),
s AS (SELECT CAST(l_partkey AS VARCHAR) AS athlete_id, p_brand AS team, min(p_name) AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT athlete_id, coalesce(m.team, s.team) AS source_team, coalesce(m.name, s.name) AS athlete_name, m.name IS NOT NULL AS roster_present, s.n IS NOT NULL AS statistics_present, CAST(coalesce(s.n, 0) AS BIGINT) AS n_statistics
FROM m FULL JOIN s USING (athlete_id)"""
)
def player_seasons_product(spark, d):
    """Parts as athletes of their brands: small ones are on the roster, returned ones have a statistic for each return."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("athlete_id"), F.col("p_brand").alias("team"), F.col("p_name").alias("name"), "p_size", "p_partkey")
    members = p.where("p_size <= 30").select(F.lit(2024).alias("season"), F.col("team").alias("source_team"), "athlete_id", F.col("name").alias("first_name"), F.lit("").alias("last_name"), F.lit("QB").alias("position"))
    # an order can return one part under one line number more than once, so a part's returns are numbered
    nth = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    back = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), nth.cast("long").alias("source_ordinal"))
    stats = back.join(p, "p_partkey").select(
        F.lit(2024).alias("season"), F.col("athlete_id").alias("player_id"), F.col("name").alias("player"), F.lit("QB").alias("position"), F.lower("team").alias("lower_team"), "team", F.lit("c").alias("conference"),
        F.lit("returned").alias("category"), F.col("source_ordinal").cast("string").alias("stat_type"), F.lit("1").alias("stat"), "source_ordinal",
    ).drop("lower_team")
    teams = p.select(F.col("team").alias("school")).distinct().select(F.crc32("school").alias("id"), "school", F.array().cast("array<string>").alias("alternate_names"))
    out = seasons.player_seasons(2024, members, stats, teams)
    return out.select("athlete_id", "source_team", "athlete_name", "roster_present", "statistics_present", long(F.size("statistics")).alias("n_statistics"))
