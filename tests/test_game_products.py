import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import ContractError
from fieldloom.products import games

GAME = (
    "id long, season long, week long, season_type string, start_date timestamp, completed boolean, venue_id long, venue string, home_id long, home_team string, "
    "home_conference string, home_classification string, home_points long, away_id long, away_team string, away_conference string, away_classification string, away_points long"
)
ABOUT = "id long, season long, week long, season_type string, start_time timestamp, home_team string, home_conference string, away_team string, away_conference string"
AT = dt.datetime(2024, 9, 1, 12)


def all_games(spark):
    g = lambda i, done, h, a: (i, 2024, 1, "regular", AT, done, 5, "Bowl", 10, "Home U", "X", "fbs", h, 20, "Away U", None, "fcs", a)
    return spark.createDataFrame([g(4, True, 3, 3), g(1, True, 7, 3), g(2, True, 3, 10), g(3, False, 3, 10), g(5, True, None, 1)], GAME)


def told(df, product, *columns):
    keys, order = games.CONTRACTS[product]
    checks.keys_unique(df, keys)
    return [tuple(r) for r in df.orderBy(*[F.asc_nulls_last(c) for c in order]).select(*columns).collect()]


def test_results(spark):
    got = told(games.game_summaries(all_games(spark)), "game_summaries", "game_id", "result_state", "total_points", "margin", "winner_id", "loser_id", "media_coverage", "weather_coverage")
    rest = ("not_requested", "not_requested")
    assert got == [
        (1, "home_win", 10, 4, 10, 20, *rest), (2, "away_win", 13, 7, 20, 10, *rest), (3, *[None] * 5, *rest), (4, "tie", 6, 0, None, None, *rest), (5, *[None] * 5, *rest),
    ]


def test_enrichments(spark):
    about = lambda i, home="HOME  u", conf=None, at=AT: (i, 2024, 1, "regular", at, home, conf, "Away U", "Y")
    media = lambda *rows: spark.createDataFrame([(*a, kind, outlet, k) for k, (a, kind, outlet) in enumerate(rows)], f"{ABOUT}, media_type string, outlet string, source_ordinal long")
    weather = lambda *rows: spark.createDataFrame([(*a, 5, venue) for a, venue in rows], f"{ABOUT}, venue_id long, venue string")
    g = all_games(spark)
    good = media((about(1, conf="X"), "tv", "b"), (about(2), "tv", "a"), (about(1), "tv", "a"))
    got = told(games.game_summaries(g, good, weather((about(2), "Bowl"))), "game_summaries", "game_id", "media_coverage", "media.outlet", "weather_coverage", "weather.venue_id")
    assert got[:3] == [(1, "present", ["b", "a"], "empty", None), (2, "present", ["a"], "present", 5), (3, "empty", [], "empty", None)]
    one = told(games.game_summaries(g.where("id = 2"), good, media_game_id=2), "game_summaries", "game_id", "media.outlet")
    assert one == [(2, ["a"])]
    late = AT + dt.timedelta(hours=1)
    for m in (media((about(1), "tv", "a"), (about(1), "tv", "a")), media((about(9), "tv", "a")), media((about(1, home="Other"), "tv", "a")), media((about(1, conf="Z"), "tv", "a")), media((about(1, at=late), "tv", "a"))):
        with pytest.raises(ContractError):
            games.game_summaries(g, m).collect()
    for w in (weather((about(1), "Bowl"), (about(1), "Bowl")), weather((about(1), "Other")), weather((about(9), "Bowl"))):
        with pytest.raises(ContractError):
            games.game_summaries(g, weather=w).collect()


def test_player_game_stats(spark):
    kind = "id long, teams array<struct<team: string, conference: string, home_away: string, points: long, categories: array<struct<name: string, types: array<struct<name: string, athletes: array<struct<id: string, name: string, stat: string>>>>>>>>"
    side = lambda where, *athletes: (f"{where}!", None, where, 3, [("rushing", [("YDS", list(athletes)), ("TD", [])])])
    page = lambda i: spark.createDataFrame([(i, [side("away", ("7", "P", "1/2")), side("home", ("9", "Q", "5"), ("8", "R", "6"))])], kind)
    summaries = games.game_summaries(all_games(spark))
    got = told(games.player_game_stats(summaries, page(1)), "player_game_stats", "team_id", "classification", "team_ordinal", "athlete_id", "stat", "stat_type", "athlete_ordinal", "season")
    assert got == [(10, "fbs", 0, "9", "5", "YDS", 0, 2024), (10, "fbs", 0, "8", "6", "YDS", 1, 2024), (20, "fcs", 1, "7", "1/2", "YDS", 0, 2024)]
    with pytest.raises(ContractError):
        games.player_game_stats(summaries, page(9)).collect()
