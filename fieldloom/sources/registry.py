"""Endpoints and the recipe sources built on them: what each may be asked for, and its rows read from stored responses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldloom.errors import RequestError
from fieldloom.plans import recipes
from fieldloom.sources import rows
from fieldloom.sources.json_pages import ORDINAL
from fieldloom.sources.responses import Responses

#: Method, path, model, shape, tier, source ("-": reached by the method only) and selectors ("!": required).
ENDPOINTS = """
adjusted_metrics.team_season /wepa/team/season AdjustedTeamMetrics list tier_1 adjusted_team_metrics: year team conference
adjusted_metrics.player_passing /wepa/players/passing PlayerWeightedEPA list tier_1 adjusted_player_passing: year team conference position
adjusted_metrics.player_rushing /wepa/players/rushing PlayerWeightedEPA list tier_1 adjusted_player_rushing: year team conference position
adjusted_metrics.kicker_paar /wepa/players/kicking KickerPAAR list tier_1 kicker_paar_metrics: year team conference
betting.lines /lines BettingGame list free betting_lines: game_id year season_type week team home away conference provider
coaches.seasons /coaches/seasons DetailedCoachSeason list free coach_seasons: coach_id team year min_year max_year
coaches.tenures /coaches/tenures CoachTenure list free coach_tenures: coach_id team year active
drives.list /drives Drive list free drives: year! season_type week team offense defense conference offense_conference defense_conference classification
games.advanced_box_score /game/box/advanced AdvancedBoxScore object free advanced_box_score: game_id!
games.media /games/media GameMedia list free game_media: year! week season_type team conference media_type classification
games.weather /games/weather GameWeather list tier_1 game_weather: game_id year week season_type team conference classification
games.list /games Game list free games: year week season_type team home away conference classification game_id competition round
games.team_stats /games/teams TeamGameStats list free team_game_stats: year week season_type team conference game_id classification
games.player_stats /games/players PlayerGameStats list free player_game_stats: year week season_type team conference category game_id classification
games.records /records TeamRecords list free team_records: year team conference
metrics.team_season_ppa /ppa/teams TeamSeasonPredictedPointsAdded list free team_season_ppa: year team conference exclude_garbage_time classification
metrics.team_game_ppa /ppa/games TeamGamePredictedPointsAdded list free team_game_ppa: year! week season_type team conference exclude_garbage_time classification
metrics.player_game_ppa /ppa/players/games PlayerGamePredictedPointsAdded list free player_game_ppa: year! week season_type team position player_id threshold exclude_garbage_time
metrics.player_season_ppa /ppa/players/season PlayerSeasonPredictedPointsAdded list free player_season_ppa: year conference team position player_id threshold exclude_garbage_time
metrics.win_probability /metrics/wp PlayWinProbability list free play_win_probabilities: game_id!
players.usage /player/usage PlayerUsage list free player_usage: year! conference position team player_id exclude_garbage_time
players.returning_production /player/returning ReturningProduction list free returning_production: year team conference
plays.list /plays Play list free plays: year! week! team offense defense offense_conference defense_conference conference play_type season_type classification
rankings.list /rankings PollWeek list free rankings: year! season_type week poll latest final
ratings.core /ratings/core TeamCoreRating list free core_ratings: year team conference
ratings.sp /ratings/sp TeamSP list free sp_ratings: year team
ratings.conference_sp /ratings/sp/conferences ConferenceSP list free conference_sp_ratings: year conference classification
ratings.srs /ratings/srs TeamSRS list free srs_ratings: year team conference
ratings.expanded_srs /ratings/srs/expanded ExpandedTeamSRS list free expanded_srs_ratings: year team conference classification
ratings.elo /ratings/elo TeamElo list free elo_ratings: year week season_type team conference
ratings.fpi /ratings/fpi TeamFPI list free fpi_ratings: year team conference
recruiting.players /recruiting/players Recruit list free recruiting_players: year team position state classification
recruiting.teams /recruiting/teams TeamRecruitingRanking list free recruiting_teams: year team
stats.player_season /stats/player/season PlayerStat list free player_season_stats: year! conference team start_week end_week season_type category
stats.team_season /stats/season TeamStat list free team_season_stats: year team conference start_week end_week classification
stats.advanced_season /stats/season/advanced AdvancedSeasonStat list free advanced_season_stats: year team exclude_garbage_time start_week end_week classification
stats.advanced_game /stats/game/advanced AdvancedGameStat list free advanced_game_stats: year team week opponent exclude_garbage_time season_type
stats.game_havoc /stats/game/havoc GameHavocStats list free game_havoc_stats: year team week opponent season_type
stats.player_season_success /stats/player/success PlayerSeasonSuccessRate list free player_season_success: year conference team player_id season_type start_week end_week threshold exclude_garbage_time
stats.player_game_success /stats/player/success/game PlayerGameSuccessRate list free player_game_success: year! week season_type conference team player_id threshold exclude_garbage_time
teams.list /teams Team list free teams: conference year
teams.roster /roster RosterPlayer list free roster: team year classification
teams.ats /teams/ats TeamATS list free team_ats: year! conference team
teams.talent /talent TeamTalent list free team_talent: year!
coaches.list /coaches Coach list free -: first_name last_name team year min_year max_year
coaches.profile /coaches/profile CoachProfile list free -: coach_id!
conferences.list /conferences Conference list free -: year classification
conferences.changes /conferences/changes TeamConferenceChange list free -: year!
conferences.affiliations /conferences/affiliations TeamConferenceAffiliation list free -: team conference year min_year max_year classification
draft.teams /draft/teams DraftTeam list free -:
draft.positions /draft/positions DraftPosition list free -:
draft.picks /draft/picks DraftPick list free -: year team school conference position
games.calendar /calendar CalendarWeek list free -: year!
games.scoreboard /scoreboard ScoreboardGame list free -: classification conference
info.account /info UserInfo object free -:
info.usage /info/usage UserUsage object free -: days limit api
metrics.predicted_points /ppa/predicted PredictedPointsValue list free -: down! distance!
metrics.pregame_win_probability /metrics/wp/pregame PregameWinProbability list free -: year week season_type team
metrics.field_goal_expected_points /metrics/fg/ep FieldGoalExpectedPoints list free -:
players.search /player/search PlayerSearchResult list free -: search_term! year team position
players.season_overview /player/season/overview PlayerSeasonOverview list free -: year! player_id!
players.transfer_portal /player/portal PlayerTransfer list free -: year!
playoffs.cfp /playoffs/cfp CfpPlayoff object free -: year!
playoffs.participants /playoffs/cfp/participants PlayoffParticipant list free -: year!
playoffs.games /playoffs/cfp/games PlayoffMatchup list free -: year! round
plays.types /plays/types PlayType list free -:
plays.stats /plays/stats PlayStat list free -: year week team game_id athlete_id stat_type_id season_type conference
plays.stat_types /plays/stats/types PlayStatType list free -:
plays.live /live/plays LiveGame object free -: game_id!
recruiting.groups /recruiting/groups AggregatedTeamRecruiting list free -: team conference recruit_type start_year end_year
stats.categories /stats/categories StatCategory scalars free -:
teams.fbs /teams/fbs Team list free -: year
teams.matchup /teams/matchup Matchup list free -: team1! team2! min_year max_year
venues.list /venues Venue list free -:
"""

#: What a selector's value may be. Selectors that aren't named here are non-empty texts.
CHOICES = {
    "season_type": ("regular", "postseason", "both", "allstar", "spring_regular", "spring_postseason"),
    "classification": ("fbs", "fcs", "ii", "iii"),
    "media_type": ("tv", "radio", "web", "ppv", "mobile"),
    "poll": ("cfp",),
    "competition": ("cfp",),
    "round": ("first_round", "quarterfinal", "semifinal", "championship"),
    "recruit_type": ("JUCO", "PrepSchool", "HighSchool"),
    "api": ("all", "cfb", "cbb"),
}
#: Whole numbers with their least values.
NUMBERS = dict.fromkeys(("year", "min_year", "max_year", "start_year", "end_year"), 1869) | dict.fromkeys(("week", "start_week", "end_week", "threshold"), 0)
NUMBERS |= dict.fromkeys(("game_id", "coach_id", "player_id", "athlete_id", "stat_type_id", "down", "distance", "days", "limit"), 1)
FLAGS = ("active", "latest", "final", "exclude_garbage_time")
#: Paths that need one of a few selectors, or that need them together.
YEAR_OR_GAME = ("/lines", "/games", "/games/weather", "/games/players", "/games/teams")
YEAR_OR_TEAM = (
    "/records", "/ppa/teams", "/ppa/players/season", "/player/returning", "/ratings/core", "/ratings/sp", "/ratings/srs", "/ratings/srs/expanded",
    "/recruiting/players", "/stats/player/success", "/stats/season", "/stats/season/advanced", "/stats/game/advanced", "/stats/game/havoc",
)
GROUPED = ("/games/players", "/games/teams")
RANGES = (("start_week", "end_week"), ("start_year", "end_year"), ("min_year", "max_year"))


@dataclass(frozen=True)
class Endpoint:
    method: str
    path: str
    model: str
    shape: str
    tier: str
    source: str
    selectors: tuple[str, ...]
    required: frozenset[str]

    @property
    def schema(self) -> T.StructType:
        return rows.model(self.model)


@cache
def endpoints() -> dict[str, Endpoint]:
    """By method."""
    found = {}
    for line in ENDPOINTS.split("\n"):
        if line:
            about, selectors = line.split(":", 1)
            method, path, model, shape, tier, source = about.split(" ")
            names = selectors.split()
            found[method] = Endpoint(method, path, model, shape, tier, "" if source == "-" else source, tuple(n.rstrip("!") for n in names), frozenset(n[:-1] for n in names if n[-1] == "!"))
    return found


def _value(e: Endpoint, name: str, v):
    choices = CHOICES["recruit_type"] if name == "classification" and e.path == "/recruiting/players" else CHOICES.get(name)
    if name in FLAGS:
        ok = isinstance(v, bool)
    elif name in NUMBERS:
        ok = isinstance(v, int) and not isinstance(v, bool) and v >= NUMBERS[name]
    elif choices:
        ok = v in choices
    else:
        ok = isinstance(v, str) and bool(v.strip())
    if not ok:
        raise RequestError(f"{e.method}: {name} can't be {v!r}")


def request(method: str, **selectors) -> dict:
    """The selectors that are set, in the endpoint's order, after every rule of the endpoint; raises before anything is read."""
    if method not in endpoints():
        raise RequestError(f"no such method: {method}")
    e = endpoints()[method]
    if unknown := set(selectors) - set(e.selectors):
        raise RequestError(f"{method} takes no {sorted(unknown)}")
    p = {n: selectors[n] for n in e.selectors if selectors.get(n) is not None}
    if missing := e.required - set(p):
        raise RequestError(f"{method} needs {sorted(missing)}")
    for n, v in p.items():
        _value(e, n, v)

    def need(*names: str) -> None:
        if not any(n in p for n in names):
            raise RequestError(f"{method} needs one of {list(names)}")

    if e.path in YEAR_OR_GAME:
        need("year", "game_id")
    if e.path in YEAR_OR_TEAM:
        need("year", "team")
    if e.path in GROUPED and "game_id" not in p:
        need("week", "team", "conference")
    for a, b in RANGES:
        if a in p and b in p and p[a] > p[b]:
            raise RequestError(f"{method}: {a} is beyond {b}")
    if "round" in p and "competition" in e.selectors and "competition" not in p:
        raise RequestError(f"{method}: round needs competition")
    if p.get("competition") == "cfp" and p.get("season_type", "both") not in ("postseason", "both"):
        raise RequestError(f"{method}: cfp games are postseason games")
    if p.get("latest") and p.get("final"):
        raise RequestError(f"{method}: latest and final exclude each other")
    if (p.get("latest") or p.get("final")) and p.get("poll") != "cfp":
        raise RequestError(f"{method}: latest and final need poll='cfp'")
    return p


def call(responses: Responses, method: str, *, now=None, mode: str | None = None, **selectors) -> DataFrame:
    """The rows of a method: of the stored response to exactly this request, fetched first where it is missing or stale."""
    e = endpoints().get(method)
    p = request(method, **selectors)
    return responses.rows(e.path, p, e.schema, shape=e.shape, now=now, mode=mode)


_open: dict[str, Responses] = {}


def use(responses: Responses) -> None:
    """The responses that sources of this session's recipes read."""
    _open["responses"] = responses


def _current(spark: SparkSession) -> Responses:
    if "responses" not in _open:
        raise RequestError("no responses are in use: call registry.use first")
    return _open["responses"]


def descriptor_source(e: Endpoint) -> recipes.Recipe:
    """The endpoint as a recipe source: schema and legal selectors are the descriptor's, its version is the stored body's."""

    def read(spark: SparkSession, **selectors) -> DataFrame:
        return call(_current(spark), e.method, **selectors)

    def version(spark: SparkSession, **selectors) -> str | None:
        return _current(spark).version(e.path, request(e.method, **selectors))

    def check(arguments: Mapping) -> None:
        """Literal requests are checked when the graph is built; a value bound later counts as given."""
        late = {k: v for k, v in arguments.items() if isinstance(v, (recipes.Bound, recipes.Node))}
        fill = {k: NUMBERS.get(k, CHOICES.get(k, ("x",))[0] if k not in NUMBERS else 1) for k in late}
        request(e.method, **{**arguments, **fill})

    read.__qualname__ = f"source.{e.source}"
    ordinal = T.StructField(ORDINAL, T.LongType())
    return recipes.source(f"sources.{e.source}", 1, T.StructType([*e.schema, ordinal]), version=version, check=check)(read)


@cache
def sources() -> dict[str, recipes.Recipe]:
    """The recipe sources by name."""
    return {e.source: descriptor_source(e) for e in endpoints().values() if e.source}
