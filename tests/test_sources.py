import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.errors import NoContent, RequestError, TransportError
from fieldloom.functions import freshness
from fieldloom.plans import recipes
from fieldloom.sources import registry, rows, transport
from fieldloom.sources.json_pages import camel
from fieldloom.sources.responses import Responses, request_key

NOW = dt.datetime(2024, 10, 5, 12, tzinfo=dt.UTC)


def sample(kind: T.DataType, k: int = 1):
    """A JSON value of a type, as responses send it."""
    if isinstance(kind, T.StructType):
        if kind.names[:2] == ["kind", "string_value"]:
            return k
        return {camel(f.name): sample(f.dataType, k) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [sample(kind.elementType, k)]
    return {"string": f"s{k}", "bigint": k, "double": k + 0.5, "boolean": True, "timestamp": "2024-09-07T16:00:00.000Z"}[kind.simpleString()]


def test_all_endpoints_are_declared():
    e = registry.endpoints()
    assert len(e) == 74 and len(registry.sources()) == 44 and len(rows.names()) == 171
    for x in e.values():
        assert x.schema.fields and x.required <= set(x.selectors)


def test_request_rules():
    ok, bad = registry.request, lambda *a, **k: pytest.raises(RequestError, registry.request, *a, **k)
    assert ok("games.list", year=2024, week=None) == {"year": 2024}
    assert ok("games.list", game_id=5, competition="cfp", round="semifinal", season_type="postseason")
    bad("games.list", week=1)
    bad("games.list", year=1700)
    bad("games.list", year=True)
    bad("games.list", year=2024, colour="red")
    bad("games.list", year=2024, round="semifinal")
    bad("games.list", year=2024, competition="cfp", season_type="regular")
    bad("games.team_stats", year=2024)
    assert ok("games.team_stats", game_id=7) and ok("games.team_stats", year=2024, week=3)
    bad("rankings.list", year=2024, latest=True)
    bad("rankings.list", year=2024, latest=True, final=True, poll="cfp")
    assert ok("rankings.list", year=2024, latest=True, poll="cfp")
    bad("stats.team_season", year=2024, start_week=5, end_week=4)
    bad("stats.team_season", classification="fbs")
    bad("recruiting.groups", start_year=2024, end_year=2020)
    assert ok("recruiting.players", year=2024, classification="JUCO")
    bad("recruiting.players", year=2024, classification="fbs")
    bad("plays.list", year=2024)
    bad("no.such")


@pytest.fixture
def store(spark, tmp_path):
    return Responses(spark, f"file://{tmp_path}/r", clock=lambda: NOW)


@pytest.mark.parametrize("method", ["games.list", "games.advanced_box_score", "stats.categories", "ratings.sp", "stats.advanced_season", "coaches.seasons", "playoffs.cfp", "stats.team_season"])
def test_rows_of_stored_responses(store, method):
    e = registry.endpoints()[method]
    p = registry.request(method, **{n: registry.NUMBERS.get(n, "x") for n in e.required or {"year": 1}.keys() & set(e.selectors)})
    item = sample(e.schema)
    body = item if e.shape == "object" else ["a", "b"] if e.shape == "scalars" else [item, item]
    odd = {}
    store.keep(e.path, p, json.dumps(body).encode(), e.schema, shape=e.shape)
    got = registry.call(store, method, mode="local_only", **p)
    assert got.schema.names == [*e.schema.names, "source_ordinal"] and not odd
    assert [r.source_ordinal for r in got.orderBy("source_ordinal").collect()] == list(range(1 if e.shape == "object" else 2))


def fetcher(*answers):
    sent = []

    def send(path, parameters, headers):
        sent.append((path, dict(parameters), dict(headers)))
        a = answers[len(sent) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    return send, sent


def test_modes_and_freshness(spark, tmp_path, monkeypatch):
    e = registry.endpoints()["teams.talent"]
    body = json.dumps([{"year": 2024, "team": "A", "talent": 1.5}]).encode()
    send, sent = fetcher(transport.Answer(200, body, {"etag": "v1"}), transport.Answer(304), transport.Answer(500), transport.Answer(500), transport.Answer(500), transport.Answer(200, body.replace(b"1.5", b"2.5")), transport.Answer(404))
    clock = [NOW]
    new = lambda mode="default": Responses(spark, f"file://{tmp_path}/r", send, mode=mode, clock=lambda: clock[0])
    read = lambda r: registry.call(r, "teams.talent", year=2024).first().talent
    with pytest.raises(NoContent):
        read(new("local_only"))
    r = new()
    assert read(r) == 1.5 and read(r) == 1.5 and len(sent) == 1  # one retrieval for each request
    assert read(new()) == 1.5 and len(sent) == 1  # fresh
    clock[0] = NOW + dt.timedelta(days=2)
    assert read(new()) == 1.5 and sent[1][2] == {"If-None-Match": "v1"}  # revalidated
    assert read(new()) == 1.5 and len(sent) == 2
    clock[0] = NOW + dt.timedelta(days=5)
    monkeypatch.setitem(transport.get.__kwdefaults__, "sleep", lambda s: None)
    assert read(new()) == 1.5 and len(sent) == 5  # stale, as the failure may pass
    assert read(new("local_only")) == 1.5
    assert read(new("refresh")) == 2.5
    assert new().version(e.path, {"year": 2024})
    with pytest.raises(TransportError):
        read(new("bypass"))
    assert new().clean(NOW + dt.timedelta(days=10)) == 0 and new().clean(NOW + dt.timedelta(days=60)) == 1
    with pytest.raises(NoContent):
        read(new("local_only"))
    assert request_key("/a", {"x": 1, "y": 2}) == request_key("/a", {"y": 2, "x": 1}) != request_key("/a", {"x": 2, "y": 1})


def test_transport():
    waits = []
    send, sent = fetcher(TimeoutError(), transport.Answer(429, headers={"Retry-After": "7"}), transport.Answer(200, b"x"))
    budget = transport.Budget(3)
    assert transport.get(send, "/a", {}, sleep=waits.append, chance=lambda: 0.5, budget=budget).body == b"x"
    assert waits == [0.25, 7.0] and budget.made == 3
    with pytest.raises(TransportError, match="used up"):
        transport.get(send, "/a", {}, budget=budget)
    for status in (400, 401, 403, 404):
        send, sent = fetcher(transport.Answer(status))
        with pytest.raises(TransportError):
            transport.get(send, "/a", {})
        assert len(sent) == 1
    assert transport.wait(10, None, lambda: 1.0) == transport.LONGEST_WAIT
    assert transport.retry_after("Sat, 05 Oct 2024 12:00:10 GMT", NOW.timestamp()) == 10 and transport.retry_after("soon", 0) is None


def test_lifetimes(spark):
    ttl, days = freshness.ttl, lambda n: dt.timedelta(days=n)
    assert ttl("/info", {}, 1, NOW) is None
    assert ttl("/games", {"year": 2020}, 3, NOW, all_closed=True).fresh_for == days(365)
    assert ttl("/games", {"year": 2024}, 3, NOW, near=True).fresh_for == days(1) and ttl("/games", {"year": 2024}, 3, NOW).fresh_for == days(3)
    assert ttl("/recruiting/players", {"year": 2025}, 0, NOW).fresh_for == days(1) and ttl("/drives", {"year": 2022}, 0, NOW).fresh_for == days(365)
    assert ttl("/roster", {"year": 2023}, 0, NOW).fresh_for == days(365) and not freshness.season_closed(2023, dt.datetime(2024, 2, 28))
    games = spark.createDataFrame([(True, NOW - days(5)), (True, NOW - days(1)), (False, NOW + days(1))], "completed boolean, start_date timestamp")
    assert tuple(freshness.game_facts(games, NOW).first()) == (3, False, True, True)
    assert tuple(freshness.game_facts(games.limit(1), NOW).first()) == (1, True, False, False)
    assert tuple(freshness.game_facts(games.limit(0), NOW).first()) == (0, False, False, False)
    d = spark.range(3).select(F.timestamp_seconds(F.col("id") * 10).alias("f"), F.timestamp_seconds(F.col("id") * 20).alias("r"))
    assert [r[0] for r in d.select(freshness.state(F.col("f"), F.col("r"), F.timestamp_seconds(F.lit(15)))).collect()] == ["expired", "stale", "fresh"]


def test_sources_check_literal_requests_when_built():
    s = registry.sources()["games"]
    with pytest.raises(RequestError):
        s(week=3)
    node = s(year=2024)
    assert registry.sources()["drives"](year=node.value("season", int), week=1).inputs == [node]
    assert recipes.plan(node)[0]["kind"] == "source"


def test_tagged_scalars(store):
    e = registry.endpoints()["stats.team_season"]
    values = ["x", 0, 127, 128, -1, -128, -129, 70000, 2.5]
    body = [sample(e.schema) | {"statName": str(k), "statValue": v} for k, v in enumerate(values)]
    store.keep(e.path, {"year": 2024}, json.dumps(body).encode(), e.schema)
    got = [r.stat_value for r in registry.call(store, "stats.team_season", year=2024).orderBy("source_ordinal").collect()]
    assert got[0].kind == "string" and got[0].string_value == "x" and got[-1].kind == "float" and got[-1].float_value == 2.5
    for v, g in zip(values[1:-1], got[1:-1]):
        size = max(1, (v + (v < 0)).bit_length() // 8 + 1)
        assert g.kind == "integer" and bytes(g.integer_value) == v.to_bytes(size, "big", signed=True) and g.string_value is None
