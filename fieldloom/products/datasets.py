"""The products as registered data sets over the registered sources, and the workflows made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import RequestError
from fieldloom.operators import joins
from fieldloom.plans.recipes import Bound, Node, dataset, step, workflow
from fieldloom.products import flat, games, seasons, team_games
from fieldloom.sources import registry

#: A history has so many seasons at most.
MOST_SEASONS = 50
CONTRACTS = flat.CONTRACTS | games.CONTRACTS | {
    "team_games": (team_games.KEYS, team_games.ORDER),
    "team_seasons": (seasons.TEAM_KEYS, seasons.TEAM_KEYS),
    "player_seasons": (seasons.PLAYER_KEYS, seasons.PLAYER_KEYS),
}


def _source(name: str, **selectors) -> Node:
    """The source asked for exactly what is given; a selector that isn't set is left out."""
    return registry.sources()[name](**{k: v for k, v in selectors.items() if v is not None})


def _product(name: str, revision: int, rules: dict[str, str] | None = None):
    keys, order = CONTRACTS[name]
    return dataset(name, revision, None, keys=keys, order=order, rules=rules)


# steps ------------------------------------------------------------------------------------------------------------------


@step("betting_lines.flatten", 1)
def flatten_betting_lines(rows: DataFrame) -> DataFrame:
    return flat.betting_lines(rows)


@step("coach_seasons.normalize", 1)
def normalize_coach_seasons(rows: DataFrame) -> DataFrame:
    return flat.coach_seasons(rows)


@step("coach_seasons.attach_tenure", 1)
def attach_tenures(rows: DataFrame, tenures: DataFrame) -> DataFrame:
    return flat.coach_seasons(rows, tenures)


@step("drives.normalize", 1)
def normalize_drives(rows: DataFrame, game_id: int | None) -> DataFrame:
    return flat.drives(rows, game_id)


@step("plays.normalize", 1)
def normalize_plays(rows: DataFrame, game_id: int | None) -> DataFrame:
    return flat.plays(rows, game_id)


@step("plays.attach_win_probability", 1)
def attach_probabilities(rows: DataFrame, probabilities: DataFrame, game_id: int) -> DataFrame:
    return flat.plays(rows, game_id, probabilities)


@step("game_summaries.normalize", 2)
def normalize_games(rows: DataFrame) -> DataFrame:
    return games.game_summaries(rows)


@step("game_summaries.select_exact_media", 1)
def select_media(rows: DataFrame, game_id: int) -> DataFrame:
    """The media of one game out of a wider page."""
    return rows.where(F.col("id") == game_id)


@step("game_summaries.attach_enrichments", 1)
def attach_to_games(rows: DataFrame, media: DataFrame | None, weather: DataFrame | None) -> DataFrame:
    return games.game_summaries(rows, media, weather)


@step("player_game_stats.flatten", 1)
def flatten_player_stats(summaries: DataFrame, stats: DataFrame) -> DataFrame:
    return games.player_game_stats(summaries, stats)


@step("poll_rankings.flatten", 1)
def flatten_polls(rows: DataFrame) -> DataFrame:
    return flat.poll_rankings(rows)


@step("recruiting_classes.compose", 1)
def compose_classes(rankings: DataFrame, recruits: DataFrame) -> DataFrame:
    return flat.recruiting_classes(rankings, recruits)


@step("rosters.normalize", 1)
def normalize_rosters(season: int, players: DataFrame, teams: DataFrame) -> DataFrame:
    return flat.rosters(players, teams, season)


@step("team_games.normalize", 1)
def normalize_team_games(summaries: DataFrame, statistics, advanced_box, advanced_box_game_id, advanced, havoc, ppa, requested_team) -> DataFrame:
    return team_games.team_games(
        summaries, statistics=statistics, advanced_box=advanced_box, advanced_box_game_id=advanced_box_game_id, advanced=advanced, havoc=havoc, ppa=ppa, requested_team=requested_team
    )


@step("team_seasons.compose", 5)
def compose_team_seasons(records: DataFrame, statistics: DataFrame, advanced: DataFrame, **enrichments) -> DataFrame:
    return seasons.team_seasons(records, statistics, advanced, **enrichments)


@step("player_seasons.compose", 2)
def compose_player_seasons(season: int, memberships: DataFrame, statistics: DataFrame, teams: DataFrame, **enrichments) -> DataFrame:
    return seasons.player_seasons(season, memberships, statistics, teams, **enrichments)


def _concatenation(name: str):
    def concatenate(groups: list[DataFrame]) -> DataFrame:
        return joins.concat(*groups)

    concatenate.__qualname__ = f"concatenate.{name}"
    return step(f"program_history.concatenate_{name}", 1)(concatenate)


CONCATENATED = {name: _concatenation(name) for name in ("game_summaries", "team_games", "team_seasons", "recruiting_classes", "poll_rankings")}


# data sets --------------------------------------------------------------------------------------------------------------


@_product("betting_lines", 1)
def betting_lines(game_id=None, season=None, season_type=None, week=None, team=None, home=None, away=None, conference=None, provider=None) -> Node:
    return flatten_betting_lines(rows=_source("betting_lines", game_id=game_id, year=season, season_type=season_type, week=week, team=team, home=home, away=away, conference=conference, provider=provider))


@_product("coach_seasons", 1)
def coach_seasons(coach_id=None, team=None, year=None, min_year=None, max_year=None, include_tenure=False, active_tenure=None) -> Node:
    if active_tenure is not None and not include_tenure:
        raise RequestError("active_tenure needs include_tenure")
    rows = _source("coach_seasons", coach_id=coach_id, team=team, year=year, min_year=min_year, max_year=max_year)
    if not include_tenure:
        return normalize_coach_seasons(rows=rows)
    return attach_tenures(rows=rows, tenures=_source("coach_tenures", coach_id=coach_id, team=team, year=year, active=active_tenure))


@_product("drives", 1)
def drives(year, season_type=None, week=None, team=None, offense=None, defense=None, conference=None, offense_conference=None, defense_conference=None, classification=None, game_id=None) -> Node:
    rows = _source(
        "drives", year=year, season_type=season_type, week=week, team=team, offense=offense, defense=defense, conference=conference, offense_conference=offense_conference,
        defense_conference=defense_conference, classification=classification,
    )
    return normalize_drives(rows=rows, game_id=game_id)


@_product("plays", 1)
def plays(year, week, team=None, offense=None, defense=None, offense_conference=None, defense_conference=None, conference=None, play_type=None, season_type=None, classification=None, game_id=None, include_win_probability=False) -> Node:
    rows = _source(
        "plays", year=year, week=week, team=team, offense=offense, defense=defense, offense_conference=offense_conference, defense_conference=defense_conference, conference=conference,
        play_type=play_type, season_type=season_type, classification=classification,
    )
    if not include_win_probability:
        return normalize_plays(rows=rows, game_id=game_id)
    if game_id is None:
        raise RequestError("win probabilities belong to one game, which must be named")
    return attach_probabilities(rows=rows, probabilities=_source("play_win_probabilities", game_id=game_id), game_id=game_id)


@_product("game_summaries", 3)
def game_summaries(year=None, week=None, season_type=None, team=None, home=None, away=None, conference=None, classification=None, game_id=None, competition=None, round=None, include_media=False, media_type=None, include_weather=False) -> Node:
    rows = _source("games", year=year, week=week, season_type=season_type, team=team, home=home, away=away, conference=conference, classification=classification, game_id=game_id, competition=competition, round=round)
    if media_type is not None and not include_media:
        raise RequestError("media_type needs include_media")
    if (include_media or include_weather) and game_id is None and (year is None or any(x is not None for x in (home, away, competition, round))):
        raise RequestError("media and weather need a game, or a season without home, away and playoff selectors")
    grouped = {"year": year, "week": week, "season_type": season_type, "team": team, "conference": conference, "classification": classification}
    media = weather = None
    if include_media and game_id is not None:
        about = normalize_games(rows=rows)
        of = {"year": about.value("season", int), "week": about.value("week", int), "season_type": about.value("season_type", str), "team": about.value("home_team", str)}
        media = select_media(rows=_source("game_media", **of, media_type=media_type), game_id=game_id)
    elif include_media:
        media = _source("game_media", **grouped, media_type=media_type)
    if include_weather:
        weather = _source("game_weather", **({"game_id": game_id} if game_id is not None else grouped))
    return attach_to_games(rows=rows, media=media, weather=weather) if media or weather else normalize_games(rows=rows)


@_product("player_game_stats", 1)
def player_game_stats(year=None, week=None, season_type=None, team=None, conference=None, category=None, game_id=None, classification=None) -> Node:
    about = game_summaries(year=year, week=week, season_type=season_type, team=team, conference=conference, game_id=game_id, classification=classification)
    stats = _source("player_game_stats", year=year, week=week, season_type=season_type, team=team, conference=conference, category=category, game_id=game_id, classification=classification)
    return flatten_player_stats(summaries=about, stats=stats)


@_product("poll_rankings", 1)
def poll_rankings(season, season_type=None, week=None, poll=None, latest=None, final=None) -> Node:
    return flatten_polls(rows=_source("rankings", year=season, season_type=season_type, week=week, poll=poll, latest=latest, final=final))


@_product("recruiting_classes", 1)
def recruiting_classes(class_year, team=None, position=None, state=None, classification=None) -> Node:
    recruits = _source("recruiting_players", year=class_year, team=team, position=position, state=state, classification=classification)
    return compose_classes(rankings=_source("recruiting_teams", year=class_year, team=team), recruits=recruits)


@_product("rosters", 1)
def rosters(season, team=None, classification=None) -> Node:
    return normalize_rosters(season=season, players=_source("roster", team=team, year=season, classification=classification), teams=_source("teams", year=season))


@_product("team_games", 1)
def team_games_of(
    year=None, week=None, season_type=None, team=None, home=None, away=None, conference=None, classification=None, game_id=None, competition=None, round=None, include_team_stats=False,
    include_advanced_box=False, include_advanced_stats=False, include_havoc=False, include_ppa=False, exclude_garbage_time=None,
) -> Node:
    if include_advanced_box and game_id is None:
        raise RequestError("a box score needs one game")
    if include_ppa and year is None:
        raise RequestError("points added need a season")
    grouped = {"year": year, "week": week, "season_type": season_type, "team": team}
    both = grouped | {"conference": conference, "classification": classification}
    wanted = lambda yes, name, **selectors: _source(name, **selectors) if yes else None
    return normalize_team_games(
        summaries=game_summaries(home=home, away=away, game_id=game_id, competition=competition, round=round, **both),
        statistics=wanted(include_team_stats, "team_game_stats", game_id=game_id, **both),
        advanced_box=wanted(include_advanced_box, "advanced_box_score", game_id=game_id),
        advanced_box_game_id=game_id,
        advanced=wanted(include_advanced_stats, "advanced_game_stats", exclude_garbage_time=exclude_garbage_time, **grouped),
        havoc=wanted(include_havoc, "game_havoc_stats", **grouped),
        ppa=wanted(include_ppa, "team_game_ppa", exclude_garbage_time=exclude_garbage_time, **both),
        requested_team=team,
    )


@_product("team_seasons", 5)
def team_seasons(
    season, team=None, conference=None, classification=None, start_week=None, end_week=None, exclude_garbage_time=None, include_ppa=False, include_talent=False, include_ats=False,
    include_returning_production=False, include_core_rating=False, include_sp_rating=False, include_srs_rating=False, include_elo_rating=False, elo_week=None, elo_season_type=None,
    include_fpi_rating=False, include_adjusted_metrics=False,
) -> Node:
    one = {"year": season, "team": team}
    mine = one | {"conference": conference}
    weeks = {"start_week": start_week, "end_week": end_week, "classification": classification}
    wanted = {
        "ppa": (include_ppa, "team_season_ppa", mine | {"exclude_garbage_time": exclude_garbage_time, "classification": classification}),
        "talent": (include_talent, "team_talent", {"year": season}),
        "ats": (include_ats, "team_ats", mine),
        "returning_production": (include_returning_production, "returning_production", mine),
        "core_rating": (include_core_rating, "core_ratings", mine),
        "sp_rating": (include_sp_rating, "sp_ratings", one),
        "srs_rating": (include_srs_rating, "srs_ratings", mine),
        "elo_rating": (include_elo_rating, "elo_ratings", mine | {"week": elo_week, "season_type": elo_season_type}),
        "fpi_rating": (include_fpi_rating, "fpi_ratings", mine),
        "adjusted_metrics": (include_adjusted_metrics, "adjusted_team_metrics", mine),
    }
    return compose_team_seasons(
        records=_source("team_records", **mine), statistics=_source("team_season_stats", **mine, **weeks),
        advanced=_source("advanced_season_stats", **one, **weeks, exclude_garbage_time=exclude_garbage_time),
        **{k: _source(name, **selectors) for k, (yes, name, selectors) in wanted.items() if yes},
    )


@_product("player_seasons", 2)
def player_seasons(
    season, team=None, conference=None, classification=None, start_week=None, end_week=None, season_type=None, category=None, position=None, threshold=None, exclude_garbage_time=None,
    include_usage=False, include_ppa=False, include_success=False, include_passing_wepa=False, include_rushing_wepa=False, include_kicker_paar=False,
) -> Node:
    mine = {"year": season, "conference": conference, "team": team}
    weeks = {"start_week": start_week, "end_week": end_week, "season_type": season_type}
    garbage = {"exclude_garbage_time": exclude_garbage_time}
    wanted = {
        "usage": (include_usage, "player_usage", mine | garbage | {"position": position}),
        "ppa": (include_ppa, "player_season_ppa", mine | garbage | {"position": position, "threshold": threshold}),
        "success": (include_success, "player_season_success", mine | garbage | weeks | {"threshold": threshold}),
        "passing_wepa": (include_passing_wepa, "adjusted_player_passing", mine | {"position": position}),
        "rushing_wepa": (include_rushing_wepa, "adjusted_player_rushing", mine | {"position": position}),
        "kicker_paar": (include_kicker_paar, "kicker_paar_metrics", mine),
    }
    return compose_player_seasons(
        season=season, memberships=rosters(season=season, team=team, classification=classification),
        statistics=_source("player_season_stats", **mine, **weeks, category=category), teams=_source("teams", year=season),
        **{k: _source(name, **selectors) for k, (yes, name, selectors) in wanted.items() if yes},
    )


@step("completed_games.select", 1)
def select_completed(rows: DataFrame) -> DataFrame:
    """Completed games, of which all must have both scores, with their total."""
    done = rows.where("completed")
    done = checks.guarded(done, (F.col("home_points").isNull() | F.col("away_points").isNull(), "a completed game has no score"))
    return done.select(F.col("id").alias("game_id"), "season", "week", "home_team", "away_team", (F.col("home_points") + F.col("away_points")).alias("total_points"))


@dataset("completed_games", 1, None, keys=["game_id"], order=["season", "week", "game_id"])
def completed_games(year, week=None, team=None) -> Node:
    return select_completed(rows=_source("games", year=year, week=week, team=team))


# workflows --------------------------------------------------------------------------------------------------------------


@workflow("single_game_analysis", 2)
def single_game_analysis(game_id, include_game_media=False, game_media_type=None, include_game_weather=False, include_team_stats=False, include_advanced_box=False, include_win_probability=False) -> dict[str, Node]:
    """Six products of one game; what the others need to know about it is bound to the game's row when the graph runs."""
    about = game_summaries(game_id=game_id, include_media=include_game_media, media_type=game_media_type, include_weather=include_game_weather)
    late: dict[str, Bound] = {"year": about.value("season", int), "week": about.value("week", int), "team": about.value("home_team", str)}
    return {
        "game_summaries": about,
        "team_games": team_games_of(game_id=game_id, include_team_stats=include_team_stats, include_advanced_box=include_advanced_box),
        "player_game_stats": player_game_stats(game_id=game_id),
        "drives": drives(**late, game_id=game_id),
        "plays": plays(**late, game_id=game_id, include_win_probability=include_win_probability),
        "betting_lines": betting_lines(game_id=game_id),
    }


_TEAM_SEASON = {
    "include_team_season_ppa": "include_ppa", "include_team_talent": "include_talent", "include_team_ats": "include_ats", "include_returning_production": "include_returning_production",
    "include_core_rating": "include_core_rating", "include_sp_rating": "include_sp_rating", "include_srs_rating": "include_srs_rating", "include_elo_rating": "include_elo_rating",
    "team_elo_week": "elo_week", "team_elo_season_type": "elo_season_type", "include_fpi_rating": "include_fpi_rating", "include_adjusted_team_metrics": "include_adjusted_metrics",
}
_TEAM_GAME = {"include_team_game_stats": "include_team_stats", "include_advanced_game_stats": "include_advanced_stats", "include_game_havoc": "include_havoc", "include_game_ppa": "include_ppa"}
_SUMMARY = {"include_game_media": "include_media", "game_media_type": "media_type", "include_game_weather": "include_weather"}
_PLAYER = {
    "include_player_usage": "include_usage", "include_player_ppa": "include_ppa", "include_player_success": "include_success", "include_passing_wepa": "include_passing_wepa",
    "include_rushing_wepa": "include_rushing_wepa", "include_kicker_paar": "include_kicker_paar",
}


def _passed(names: dict[str, str], options: dict) -> dict:
    return {own: options[name] for name, own in names.items() if name in options}


def _known(options: dict, *groups: dict[str, str]) -> None:
    if unknown := set(options) - {n for g in groups for n in g}:
        raise RequestError(f"no such parameters: {sorted(unknown)}")


def _of_season(season: int, team: str, season_type, classification, garbage, options: dict) -> dict[str, Node]:
    about = {"year": season, "team": team, "season_type": season_type, "classification": classification}
    return {
        "game_summaries": game_summaries(**about, **_passed(_SUMMARY, options)),
        "team_games": team_games_of(**about, exclude_garbage_time=garbage, **_passed(_TEAM_GAME, options)),
        "team_seasons": team_seasons(season=season, team=team, classification=classification, exclude_garbage_time=garbage, **_passed(_TEAM_SEASON, options)),
    }


@workflow("team_season_analysis", 3)
def team_season_analysis(season, team, season_type=None, classification=None, include_coach_tenure=False, exclude_garbage_time=None, **options) -> dict[str, Node]:
    """Seven products of a team's season; options are named as in _SUMMARY, _TEAM_GAME, _TEAM_SEASON and _PLAYER."""
    _known(options, _SUMMARY, _TEAM_GAME, _TEAM_SEASON, _PLAYER)
    about = {"team": team, "season_type": season_type, "classification": classification}
    return _of_season(season, team, season_type, classification, exclude_garbage_time, options) | {
        "player_game_stats": player_game_stats(year=season, **about),
        "rosters": rosters(season=season, team=team, classification=classification),
        "player_seasons": player_seasons(season=season, exclude_garbage_time=exclude_garbage_time, **about, **_passed(_PLAYER, options)),
        "coach_seasons": coach_seasons(year=season, team=team, include_tenure=include_coach_tenure),
    }


@workflow("program_history", 3)
def program_history(team, start_season, end_season, season_type=None, classification=None, recruit_classification=None, include_coach_tenure=False, exclude_garbage_time=None, **options) -> dict[str, Node]:
    """Six products of a team over seasons, of which the yearly ones are concatenated."""
    _known(options, _SUMMARY, _TEAM_GAME, _TEAM_SEASON)
    if not 0 <= end_season - start_season < MOST_SEASONS:
        raise RequestError(f"a history has 1 to {MOST_SEASONS} seasons")
    years = range(start_season, end_season + 1)
    parts = [
        _of_season(y, team, season_type, classification, exclude_garbage_time, options)
        | {"recruiting_classes": recruiting_classes(class_year=y, team=team, classification=recruit_classification), "poll_rankings": poll_rankings(season=y, season_type=season_type)}
        for y in years
    ]
    named = [{k: n.as_(f"{k}-{y}") for k, n in p.items()} for y, p in zip(years, parts)]
    out = {name: concatenated(groups=[p[name] for p in named]) for name, concatenated in CONCATENATED.items()}
    return out | {"coach_seasons": coach_seasons(team=team, min_year=start_season, max_year=end_season, include_tenure=include_coach_tenure)}


PRODUCTS = {
    "betting_lines": betting_lines, "coach_seasons": coach_seasons, "drives": drives, "plays": plays, "game_summaries": game_summaries, "player_game_stats": player_game_stats,
    "poll_rankings": poll_rankings, "recruiting_classes": recruiting_classes, "rosters": rosters, "team_games": team_games_of, "team_seasons": team_seasons,
    "player_seasons": player_seasons, "completed_games": completed_games,
}
