import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.plans import recipes
from fieldloom.products import datasets, games, seasons, team_games
from fieldloom.sources import registry, rows
from fieldloom.sources.responses import Responses
from tests.test_sources import NOW, sample

AT = dt.datetime(2024, 9, 7, 16)


def of(spark, model, *given):
    """Rows of a model from dicts: what isn't given is a sample value, None stays null."""
    schema = rows.model(model)
    base = {k: sample_of(f.dataType) for k, f in zip(schema.names, schema)}
    loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema] + [type(schema[0])("source_ordinal", rows.typed("long"), True)])
    return spark.createDataFrame([tuple({n: g.get(n, v) for n, v in base.items()}.values()) + (k,) for k, g in enumerate(given)], loose)


def sample_of(kind):
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        if kind.names[:2] == ["kind", "string_value"]:
            return ("string", "1", None, None)
        return tuple(sample_of(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [sample_of(kind.elementType)]
    return {"string": "s", "bigint": 1, "double": 1.5, "boolean": True, "timestamp": AT}[kind.simpleString()]


def fails(df, what):
    with pytest.raises(Exception, match=what):
        df.collect()


@pytest.fixture(scope="module")
def summaries(spark):
    game = {"season": 2024, "week": 2, "season_type": "regular", "completed": True, "home_conference": "C", "away_conference": None, "playoff": None}
    g = of(
        spark, "Game", game | {"id": 7, "home_id": 1, "home_team": "Alpha", "home_points": 20, "away_id": 2, "away_team": "Beta", "away_points": 17},
        game | {"id": 8, "home_id": 3, "home_team": "Gamma", "home_points": 3, "away_id": 1, "away_team": "Alpha", "away_points": 3},
    )
    return games.game_summaries(g)


def test_team_games(spark, summaries):
    out = team_games.team_games(summaries)
    checks.keys_unique(out, team_games.KEYS)
    got = [tuple(r) for r in out.orderBy(*team_games.ORDER).select("game_id", "team", "home_away", "opponent", "points", "result", "point_differential", "margin", "havoc_coverage").collect()]
    assert got == [
        (7, "Alpha", "home", "Beta", 20, "win", 3, 3, "not_requested"), (7, "Beta", "away", "Alpha", 17, "loss", -3, 3, "not_requested"),
        (8, "Gamma", "home", "Alpha", 3, "tie", 0, 0, "not_requested"), (8, "Alpha", "away", "Gamma", 3, "tie", 0, 0, "not_requested"),
    ]
    side = lambda i, s, stats: (i, "n", None, s, 1, stats)
    full = [{"id": 7, "teams": [side(1, "home", [("yards", "9")]), side(2, "away", [])]}, {"id": 8, "teams": [side(3, "home", []), side(1, "away", [("x", "1")])]}]
    stats = of(spark, "TeamGameStats", *full)
    got = team_games.team_games(summaries, statistics=stats).orderBy(*team_games.ORDER).select("team_stats_coverage").collect()
    assert [r[0] for r in got] == ["present", "empty", "empty", "present"]
    fails(team_games.team_games(summaries, statistics=of(spark, "TeamGameStats", full[0])), "incomplete")
    fails(team_games.team_games(summaries, statistics=of(spark, "TeamGameStats", *full, full[0])), "twice")
    swapped = {"id": 7, "teams": [side(1, "away", []), side(2, "home", [])]}
    fails(team_games.team_games(summaries, statistics=of(spark, "TeamGameStats", swapped, full[1])), "other side")


def test_team_game_units(spark, summaries):
    about = {"season": 2024, "week": 2, "season_type": "regular"}
    one = lambda game, team, opponent, **more: about | {"game_id": game, "team": team, "opponent": opponent} | more
    alpha = [one(7, " ALPHA", "beta"), one(8, "alpha", "Gamma")]
    every = [*alpha, one(7, "Beta", "Alpha"), one(8, "Gamma", "Alpha")]
    build = lambda *given, **k: team_games.team_games(summaries, advanced=of(spark, "AdvancedGameStat", *given), **k)
    cover = lambda df: [r[0] for r in df.orderBy(*team_games.ORDER).select("advanced_stats_coverage").collect()]
    assert cover(build(*every)) == ["present"] * 4
    assert cover(build(*alpha, requested_team="Alpha")) == ["present", "not_requested", "not_requested", "present"]
    assert cover(build()) == ["empty"] * 4
    assert cover(build(requested_team="alpha")) == ["empty", "not_requested", "not_requested", "empty"]
    fails(build(*alpha), "incomplete")
    fails(build(*every, requested_team="Beta"), "not every game")
    fails(build(*every, every[0]), "twice")
    fails(build(*every, one(9, "Alpha", "Beta")), "outside")
    fails(build(*every[1:], one(7, "Alpha", "Gamma")), "another game's context")
    havoc = [{**r, "conference": "C" if (r["game_id"], r["team"].strip().lower()) == (7, "alpha") else "D", "opponent_conference": "C" if r["opponent"] == "Alpha" and r["game_id"] == 7 else "D"} for r in every]
    havoc = [{**r, "conference": "C", "opponent_conference": "D"} if r["team"] == "Gamma" else {**r, "opponent_conference": "C"} if r["opponent"] == "Gamma" else r for r in havoc]
    assert team_games.team_games(summaries, havoc=of(spark, "GameHavocStats", *havoc)).where("havoc_offense is not null").count() == 4
    fails(team_games.team_games(summaries, havoc=of(spark, "GameHavocStats", *[{**r, "conference": "Z"} for r in havoc])), "another conference")
    ppa = [{**r, "conference": "C"} for r in every]
    assert team_games.team_games(summaries, ppa=of(spark, "TeamGamePredictedPointsAdded", *ppa)).where("ppa_coverage = 'present'").count() == 4


def test_advanced_box(spark, summaries):
    one = summaries.where("game_id = 7")
    info = lambda home: (home, 20, 0.5, "Beta", 17, 0.5, True, 1.0)
    box = of(spark, "AdvancedBoxScore", {"game_info": info("alpha")})
    got = team_games.team_games(one, advanced_box=box, advanced_box_game_id=7).collect()
    assert len(got) == 2 and all(r.advanced_box.game_info.home_points == 20 and r.advanced_box_coverage == "present" for r in got)
    for base, game, other in ((summaries, 7, box), (one, 8, box), (one, 7, of(spark, "AdvancedBoxScore", {"game_info": info("Gamma")})), (one, 7, box.union(box))):
        with pytest.raises(ValueError):
            team_games.team_games(base, advanced_box=other, advanced_box_game_id=game)


def test_team_seasons(spark):
    team = lambda i, n, **k: {"year": 2024, "team_id": i, "team": n, "conference": "C"} | k
    records = of(spark, "TeamRecords", team(2, "Beta"), team(1, "Alpha"))
    stat = lambda n, s: {"season": 2024, "team": n, "stat_name": s}
    stats = of(spark, "TeamStat", stat("beta", "y"), stat("Alpha", "b"), stat("Alpha", "a"), stat("Other", "a"))
    season = lambda n, **k: {"season": 2024, "team": n, "conference": "C"} | k
    advanced = of(spark, "AdvancedSeasonStat", season("Alpha"), season("Beta"), season("Other"))
    build = lambda **k: seasons.team_seasons(records, stats, advanced, **k)
    got = build().orderBy(*seasons.TEAM_KEYS).collect()
    assert [(r.team_id, [s.name for s in r.statistics], r.elo_rating_coverage, r.ppa) for r in got] == [(1, ["b", "a"], "not_requested", None), (2, ["y"], "not_requested", None)]
    ppa = lambda *n: of(spark, "TeamSeasonPredictedPointsAdded", *map(season, n))
    assert {r.ppa_coverage for r in build(ppa=ppa("Alpha", "beta")).collect()} == {"present"} and {r.ppa_coverage for r in build(ppa=ppa()).collect()} == {"empty"}
    fails(build(ppa=ppa("Alpha")), "incomplete")
    fails(build(ppa=ppa("Alpha", "Beta", "Other")), "outside")
    fails(build(ppa=ppa("Alpha", "Beta", "Beta ")), "twice")
    rating = lambda *r: of(spark, "TeamElo", *[team(0, n, conference=c) for n, c in r])
    assert build(elo_rating=rating(("Alpha", "C"), ("Beta", "C"), ("Other", "Z"))).where("elo_rating_coverage = 'present'").count() == 2
    fails(build(elo_rating=rating(("Other", "Z"))), "incomplete")
    fails(build(elo_rating=rating(("Alpha", "Z"), ("Beta", "C"))), "another conference")
    ats = lambda *t: of(spark, "TeamATS", *[team(i, n, conference=None) for i, n in t])
    assert build(ats=ats((1, "ALPHA"), (2, "Beta"), (9, "Z"))).where("ats_coverage = 'present'").count() == 2
    fails(build(ats=ats((1, "Beta"), (2, "Beta"))), "another team's name")
    fails(seasons.team_seasons(records, stats.where("team = 'Alpha'"), advanced), "don't cover")
    fails(seasons.team_seasons(records, stats, advanced.where("team = 'Alpha'")), "don't cover")
    fails(seasons.team_seasons(records, stats.union(stats.where("stat_name = 'a'")), advanced), "one twice")
    fails(seasons.team_seasons(records.union(records), stats, advanced), "twice in a season")
    with pytest.raises(TypeError):
        build(colour=records)


def test_player_seasons(spark):
    from fieldloom.products import flat

    teams = of(spark, "Team", {"id": 1, "school": "Alpha", "alternate_names": ["Al", "Both"]}, {"id": 2, "school": "Beta", "alternate_names": ["Both"]})
    player = lambda i, team, first, last: {"id": i, "team": team, "first_name": first, "last_name": last, "year": 3, "position": "QB"}
    roster = flat.rosters(of(spark, "RosterPlayer", player("a", "Alpha", "Ann", "Lee"), player("b", "Both", "", "Ray")), teams, 2024)
    stat = lambda i, team, kind, name="N", s=2024: {"season": s, "player_id": i, "team": team, "player": name, "position": "WR", "category": "c", "stat_type": kind}
    stats = of(spark, "PlayerStat", stat("a", "ALPHA", "y"), stat("a", "Alpha", "x"), stat("z", "Nowhere", "x", "Zed"))
    build = lambda **k: seasons.player_seasons(2024, roster, k.pop("stats", stats), teams, **k)
    got = {r.athlete_id: r for r in build().collect()}
    assert len(got) == 3 and got["a"].athlete_name == "Ann Lee" and got["b"].athlete_name == "Ray" and got["z"].athlete_name == "Zed"
    assert [s.stat_type for s in got["a"].statistics] == ["y", "x"] and got["b"].statistics == [] and got["a"].position == "QB" and got["z"].position == "WR"
    assert (got["a"].team_id, got["b"].team_identity_status, got["b"].team_identity_candidate_ids, got["z"].team_identity_status) == (1, "ambiguous", [1, 2], "unresolved")
    assert (got["z"].roster_present, got["z"].statistics_present, got["b"].statistics_present, got["a"].source_team) == (False, True, False, "Alpha")
    usage = lambda *ids, s=2024: of(spark, "PlayerUsage", *[{"season": s, "team": t, "id": i} for i, t in ids])
    assert {r.athlete_id: r.usage_coverage for r in build(usage=usage(("a", "alpha"))).collect()} == {"a": "present", "b": "empty", "z": "empty"}
    fails(build(usage=usage(("a", "Beta"))), "outside")
    fails(build(usage=usage(("a", "alpha"), ("a", "Alpha"))), "twice")
    fails(build(usage=usage(("a", "alpha"), s=2023)), "another season")
    fails(build(stats=of(spark, "PlayerStat", stat("a", "Alpha", "x", "M"), stat("a", "Alpha", "y", "N"))), "disagree")
    fails(build(stats=of(spark, "PlayerStat", stat("a", "Alpha", "x"), stat("a", "alpha", "x"))), "twice")
    fails(build(stats=of(spark, "PlayerStat", stat("a", "Alpha", "x", s=2023))), "another season")
    wepa = of(spark, "PlayerWeightedEPA", {"year": 2024, "athlete_id": "z", "team": "nowhere"})
    assert build(passing_wepa=wepa).where("passing_wepa is not null").count() == 1


def keep(store, method, body, **selectors):
    e = registry.endpoints()[method]
    store.keep(e.path, registry.request(method, **selectors), json.dumps(body).encode(), e.schema, shape=e.shape)


def test_single_game_workflow(spark, tmp_path):
    store = Responses(spark, f"file://{tmp_path}/r", clock=lambda: NOW, mode="local_only")
    registry.use(store)
    item = lambda model, **k: sample(rows.model(model)) | k
    keep(store, "games.list", [item("Game", id=7, season=2024, week=2, seasonType="regular", homeId=1, homeTeam="Alpha", awayId=2, awayTeam="Beta", homePoints=3, awayPoints=1)], game_id=7)
    keep(store, "games.player_stats", [], game_id=7)
    context = {"year": 2024, "week": 2, "team": "Alpha"}
    keep(store, "drives.list", [item("Drive", gameId=7, id="d1"), item("Drive", gameId=9, id="d2")], **context)
    keep(store, "plays.list", [item("Play", gameId=7, id="p1"), item("Play", gameId=7, id="p2")], **context)
    keep(store, "betting.lines", [item("BettingGame", id=7)], game_id=7)
    out = recipes.run(datasets.single_game_analysis(game_id=7), spark)
    assert {k: v.count() for k, v in out.items()} == {"game_summaries": 1, "team_games": 2, "player_game_stats": 0, "drives": 1, "plays": 2, "betting_lines": 1}
    assert out["team_games"].where("result = 'win'").first().team == "Alpha"


def test_history_concatenates_seasons(spark, tmp_path):
    store = Responses(spark, f"file://{tmp_path}/r", clock=lambda: NOW, mode="local_only")
    registry.use(store)
    item = lambda model, **k: sample(rows.model(model)) | k
    for year in (2022, 2023):
        keep(store, "games.list", [item("Game", id=year, season=year, homeTeam="Alpha", awayTeam="Beta", homeId=1, awayId=2, completed=True)], year=year, team="Alpha")
        keep(store, "games.records", [item("TeamRecords", year=year, teamId=1, team="Alpha")], year=year, team="Alpha")
        keep(store, "stats.team_season", [], year=year, team="Alpha")
        keep(store, "stats.advanced_season", [], year=year, team="Alpha")
        keep(store, "recruiting.teams", [item("TeamRecruitingRanking", year=year, team="Alpha")], year=year, team="Alpha")
        keep(store, "recruiting.players", [], year=year, team="Alpha")
        keep(store, "rankings.list", [], year=year)
    keep(store, "games.list", [item("Game", id=k, season=2022, completed=k < 3, homePoints=k, awayPoints=k) for k in (1, 2, 3)], year=2022, week=1)
    assert [r.total_points for r in recipes.run(datasets.completed_games(year=2022, week=1), spark).collect()] == [2, 4]
    graph = datasets.program_history(team="Alpha", start_season=2022, end_season=2023)
    some = {k: graph[k] for k in ("game_summaries", "team_games", "recruiting_classes", "poll_rankings")}
    out = recipes.run(some, spark)
    assert {k: v.count() for k, v in out.items()} == {"game_summaries": 2, "team_games": 4, "recruiting_classes": 2, "poll_rankings": 0}
    with pytest.raises(recipes.RunError) as e:
        recipes.run({"team_seasons": graph["team_seasons"]}, spark)
    assert e.value.category == "contract"
    with pytest.raises(ValueError):
        datasets.program_history(team="Alpha", start_season=1950, end_season=2020)


def test_order_check(spark):
    d = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    assert checks.disorder(d, "o", ["v"]).count() == 0
    bad = d.withColumn("v", F.expr("if(o = 500, 0, v)"))
    assert [tuple(r) for r in checks.disorder(bad, "o", ["v"]).collect()] == [(499, 500)]
    with pytest.raises(ValueError):
        checks.ordered(bad, "o", ["v"])
    assert checks.disorder(d.withColumn("v", F.expr("if(o > 990, null, v)")), "o", ["v"]).count() == 0
    assert checks.disorder(d.withColumn("v", F.expr("if(o < 9, null, v)")), "o", ["v"]).count() == 1
