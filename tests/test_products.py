import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import ContractError
from fieldloom.products import flat
from fieldloom.sources import rows as R


def frame(spark, schema, *rows):
    """Rows of a source; columns not given are null."""
    names = schema.names
    loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], loose).withColumn("source_ordinal", F.monotonically_increasing_id())


def told(df, product, *columns):
    keys, order = flat.CONTRACTS[product]
    checks.keys_unique(df, keys)
    return [tuple(r) for r in df.orderBy(*[F.asc_nulls_last(c) for c in order]).select(*columns).collect()]


def test_betting_lines(spark):
    line = lambda p, s: Row(provider=p, spread=s, formatted_spread="x", spread_open=None, over_under=None, over_under_open=None, home_moneyline=None, away_moneyline=-110)
    games = frame(spark, R.BETTING_GAME, {"id": 2, "season": 2024, "week": 1, "lines": [line("b", 1.5), line("a", None)]}, {"id": 1, "season": 2024, "week": 1, "lines": []})
    assert told(flat.betting_lines(games), "betting_lines", "game_id", "provider", "source_ordinal", "spread", "away_moneyline") == [(2, "b", 0, 1.5, -110), (2, "a", 1, None, -110)]


def test_poll_rankings(spark):
    rank = lambda t: Row(rank=None, team_id=t, school=f"s{t}", conference=None, first_place_votes=1, points=2)
    weeks = frame(spark, R.POLL_WEEK, {"season": 2024, "season_type": "regular", "week": 1, "polls": [Row(poll="p", is_final=None, ranks=[rank(9), rank(3)]), Row(poll="q", is_final=True, ranks=[])]})
    assert told(flat.poll_rankings(weeks), "poll_rankings", "poll", "team_id", "poll_ordinal", "rank_ordinal") == [("p", 9, 0, 0), ("p", 3, 0, 1)]


def test_drives(spark):
    at = lambda m, s: Row(seconds=s, minutes=m)
    one = {"offense": "a", "defense": "b", "game_id": 1, "start_time": at(15, 0), "end_time": at(None, 5), "elapsed": at(2, 5), "start_offense_score": 0, "start_defense_score": 3, "end_offense_score": 7, "end_defense_score": 3}
    df = flat.drives(frame(spark, R.DRIVE, {**one, "id": "x"}, {**one, "id": "y", "drive_number": 4}, {**one, "id": "z", "game_id": 2}), game_id=1)
    want = [("y", 900, None, 125, 7, 0), ("x", 900, None, 125, 7, 0)]
    assert told(df, "drives", "drive_id", "start_clock_seconds", "end_clock_seconds", "elapsed_seconds", "offense_score_change", "defense_score_change") == want


def test_plays(spark):
    play = lambda i, g=1, n=None: {"id": i, "game_id": g, "drive_number": 1, "play_number": n, "clock": Row(minutes=1, seconds=2)}
    plays = frame(spark, R.PLAY, play("a"), play("b", n=1), play("c", 2))
    assert told(flat.plays(plays), "plays", "play_id", "clock_seconds", "win_probability_coverage") == [("b", 62, "not_requested"), ("a", 62, "not_requested"), ("c", 62, "not_requested")]
    p = lambda *ids, g=1: frame(spark, R.WIN_PROBABILITY, *[{"play_id": i, "game_id": g, "home_win_probability": 0.5} for i in ids])
    assert told(flat.plays(plays, 1, p("a", "b")), "plays", "play_id", "win_probability.home_win_probability", "win_probability_coverage") == [("b", 0.5, "present"), ("a", 0.5, "present")]
    for bad in (p("a"), p("a", "b", "d"), p("a", "a", "b"), p("a", "b", g=2)):
        with pytest.raises(ContractError):
            flat.plays(plays, 1, bad).collect()


def test_rosters(spark):
    teams = spark.createDataFrame([(1, "Tech", ["T  U"]), (2, "State", ["tech"]), (3, "Far", None)], "id long, school string, alternate_names array<string>")
    players = frame(spark, R.ROSTER_PLAYER, *[{"id": str(k), "team": t, "year": 2} for k, t in enumerate(["TECH", "t u", "none", "FAR "])])
    want = {"0": (None, "ambiguous", [1, 2]), "1": (1, "resolved", [1]), "2": (None, "unresolved", []), "3": (3, "resolved", [3])}
    got = told(flat.rosters(players, teams, 2024), "rosters", "athlete_id", "team_id", "team_identity_status", "team_identity_candidate_ids")
    assert {g[0]: g[1:] for g in got} == want


def test_recruiting_classes(spark):
    rankings = frame(spark, R.CLASS_RANKING, {"year": 2025, "rank": 20, "team": "B", "points": 1.0}, {"year": 2025, "rank": 5, "team": "Straße", "points": 2.0})
    recruits = frame(spark, R.RECRUIT, {"id": "z", "year": 2025, "committed_to": "STRASSE "}, {"id": "y", "year": 2025}, {"id": "x", "year": 2025, "committed_to": "New"}, {"id": "a", "year": 2025, "committed_to": "strasse"})
    got = told(flat.recruiting_classes(rankings, recruits), "recruiting_classes", "class_ordinal", "class_key", "source_team", "status", "recruit_count", "recruits.id")
    assert got == [
        (0, "team:strasse", "Straße", "ranked", 2, ["z", "a"]), (1, "team:b", "B", "ranked", 0, []),
        (2, "team:new", "New", "commitments_only", 1, ["x"]), (3, "uncommitted", None, "uncommitted", 1, ["y"]),
    ]
    for a, b in ((rankings.union(rankings), recruits), (rankings, recruits.union(recruits))):
        with pytest.raises(ContractError):
            flat.recruiting_classes(a, b).collect()


def test_coach_seasons(spark):
    seasons = spark.createDataFrame([(2020, (1, "T", None), (7, "A", "B"), 9), (2022, (1, "T", "C"), (7, "A", "B"), 3)], "year long, team struct<id: long, school: string, conference: string>, coach struct<id: long, first_name: string, last_name: string>, wins long")
    assert told(flat.coach_seasons(seasons), "coach_seasons", "year", "team_id", "coach_last_name", "wins", "tenure_coverage") == [(2020, 1, "B", 9, "not_requested"), (2022, 1, "B", 3, "not_requested")]
    t = lambda a, b, i=1: {"id": i, "coach": (7, "A", "B"), "team": (1, "T"), "start_year": a, "end_year": b, "effective_start": dt.datetime(2020, 1, 1)}
    got = flat.coach_seasons(seasons, frame(spark, R.COACH_TENURE, t(2019, 2021), t(2022, None, 2)))
    assert told(got, "coach_seasons", "year", "tenure_id", "tenure_coverage") == [(2020, 1, "present"), (2022, 2, "present")]
    for bad in ([t(2019, 2021)], [t(2019, None), t(2022, None, 2)]):
        with pytest.raises(ContractError):
            flat.coach_seasons(seasons, frame(spark, R.COACH_TENURE, *bad)).collect()
