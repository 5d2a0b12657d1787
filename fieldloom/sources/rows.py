"""Declared rows of every response: one table of models, from which schemas are built when they are asked for."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

from fieldloom.errors import ContractError
from fieldloom.schema import TAGGED_SCALAR

#: The columns of each response model in their order. "+X" stands for all columns of X, of which those
#: that are named again take the new type in their old place; "?" marks a column that may be null.
MODELS = """
# adjusted_metrics
AdjustedTeamMetricsEPA: total double, passing double, rushing double
AdjustedTeamMetricsSuccessRate: total double, standard_downs double, passing_downs double
AdjustedTeamMetricsRushing: line_yards double, second_level_yards double, open_field_yards double, highlight_yards double
AdjustedTeamMetrics: year long, team_id long, team string, conference string, epa AdjustedTeamMetricsEPA, epa_allowed AdjustedTeamMetricsEPA,
  success_rate AdjustedTeamMetricsSuccessRate, success_rate_allowed AdjustedTeamMetricsSuccessRate, rushing AdjustedTeamMetricsRushing,
  rushing_allowed AdjustedTeamMetricsRushing, explosiveness double, explosiveness_allowed double
PlayerWeightedEPA: year long, athlete_id string, athlete_name string, position string, team string, conference string, wepa double, plays long
KickerPAAR: year long, athlete_id string, athlete_name string, team string, conference string, paar double, attempts long
# betting
GameLine: provider string, spread double?, formatted_spread string, spread_open double?, over_under double?, over_under_open double?,
  home_moneyline long?, away_moneyline long?
BettingGame: id long, season long, season_type string, week long, start_date timestamp, home_team_id long, home_team string, home_conference string?,
  home_classification string?, home_score long?, away_team_id long, away_team string, away_conference string?, away_classification string?,
  away_score long?, lines array<GameLine>
# coaches
CoachSeason: team_id long, school string, conference string?, year long, games long, wins long, losses long, ties long, win_percentage double?,
  preseason_rank long?, postseason_rank long?, srs double?, sp_overall double?, sp_offense double?, sp_defense double?
Coach: id long, first_name string, last_name string, hire_date timestamp?, seasons array<CoachSeason>
CoachRecord: games long, wins long, losses long, ties long, win_percentage double?
CoachReference: id long, first_name string, last_name string
CoachTeamReference: id long, school string
CoachSeasonTeamReference: +CoachTeamReference, conference string?
CoachCareer: +CoachRecord, seasons long, teams long, first_year long, last_year long
CoachAlmaMater: id long, school string
CoachProfile: id long, first_name string, last_name string, display_name string?, current_team CoachSeasonTeamReference?, career CoachCareer,
  birth_date string?, alma_mater CoachAlmaMater?, graduation_year long?, wikidata_id string?, hall_of_fame_year long?
CoachTenure: id long, coach CoachReference, team CoachTeamReference, hire_date string?, start_year long, end_year long?, effective_start timestamp?,
  effective_end timestamp?, is_interim boolean, active boolean, seasons long, record CoachRecord, attribution_complete boolean
CoachYearOverYear: wins long?, srs double?, sp_overall double?
CoachRatingContext: sp_special_teams double?, strength_of_schedule double?, second_order_wins double?, fpi double?, year_over_year CoachYearOverYear
CoachRecruitingContext: rank long?, points double?, talent double?
CoachPollResume: preseason_rank long?, postseason_rank long?, best_rank long?, weeks_ranked long, weeks_top_ten long
CoachRecordSplits: conference CoachRecord, postseason CoachRecord, home CoachRecord, away CoachRecord, neutral CoachRecord
CoachScoring: points_for long, points_against long, average_point_differential double?
CoachCfpContext: appeared boolean, seed long?, outcome string?
CoachDraftContext: year long, total_picks long, first_round_picks long
DetailedCoachSeason: +CoachRecord, coach CoachReference, team CoachSeasonTeamReference, year long, preseason_rank long?, postseason_rank long?,
  srs double?, sp_overall double?, sp_offense double?, sp_defense double?, team_metrics CoachRatingContext, recruiting CoachRecruitingContext,
  poll_resume CoachPollResume?, attribution_complete boolean, record_splits CoachRecordSplits?, scoring CoachScoring?, cfp CoachCfpContext,
  draft_following_season CoachDraftContext?
# conferences
Conference: id long, name string, short_name string?, abbreviation string?, classification string?, member_count long
TeamConferenceAffiliation: team_id long, team string, conference_id long, conference string, conference_abbreviation string?, classification string?,
  conference_division string?, start_year long, end_year long?
TeamConferenceChange: team_id long, team string, from_conference_id long, from_conference string, from_conference_abbreviation string?,
  from_classification string?, to_conference_id long, to_conference string, to_conference_abbreviation string?, to_classification string?,
  effective_year long
# draft
DraftTeam: location string, nickname string?, display_name string?, logo string?
DraftPosition: name string, abbreviation string
DraftPickHometown: city string?, state string?, country string?, latitude string?, longitude string?, county_fips string?
DraftPick: college_athlete_id long?, nfl_athlete_id long, college_id long, college_team string, college_conference string?, nfl_team_id long,
  nfl_team string, year long, overall long, round long, pick long, name string, position string, height double?, weight long?,
  pre_draft_ranking long?, pre_draft_position_ranking long?, pre_draft_grade long?, hometown_info DraftPickHometown
# drives
DriveTime: seconds long?, minutes long?
Drive: offense string, offense_conference string?, defense string, defense_conference string?, game_id long, id string, drive_number long?,
  scoring boolean, start_period long, start_yardline long, start_yards_to_goal long, start_time DriveTime, end_period long, end_yardline long,
  end_yards_to_goal long, end_time DriveTime, elapsed DriveTime, plays long, yards long, drive_result string, is_home_offense boolean,
  start_offense_score long, start_defense_score long, end_offense_score long, end_defense_score long
# games
GamePlayoff: competition string, format string, round string, round_name string, bracket_slot string, home_seed long?, away_seed long?,
  bowl_name string?
Game: id long, season long, week long, season_type string, start_date timestamp, start_time_tbd boolean, completed boolean, neutral_site boolean,
  conference_game boolean, attendance long?, venue_id long?, venue string?, home_id long, home_team string, home_conference string?,
  home_classification string?, home_points long?, home_line_scores array<double>?, home_postgame_win_probability double?, home_pregame_elo long?,
  home_postgame_elo long?, away_id long, away_team string, away_conference string?, away_classification string?, away_points long?,
  away_line_scores array<double>?, away_postgame_win_probability double?, away_pregame_elo long?, away_postgame_elo long?, excitement_index double?,
  highlights string?, notes string?, playoff GamePlayoff?
CalendarWeek: season long, week long, season_type string, start_date timestamp, end_date timestamp, first_game_start timestamp,
  last_game_start timestamp
GameMedia: id long, season long, week long, season_type string, start_time timestamp, is_start_time_tbd boolean, home_team string,
  home_conference string?, away_team string, away_conference string?, media_type string, outlet string
GameWeather: id long, season long, week long, season_type string, start_time timestamp, game_indoors boolean, home_team string,
  home_conference string?, away_team string, away_conference string?, venue_id long, venue string, temperature double?, dew_point double?,
  humidity double?, precipitation double?, snowfall double?, wind_direction double?, wind_speed double?, pressure double?,
  weather_condition_code double?, weather_condition string?
TeamRecord: games long, wins long, losses long, ties long
TeamRecords: year long, team_id long, team string, classification string?, conference string, division string, expected_wins double?,
  total TeamRecord, conference_games TeamRecord, home_games TeamRecord, away_games TeamRecord, neutral_site_games TeamRecord,
  regular_season TeamRecord, postseason TeamRecord
ScoreboardVenue: name string?, city string?, state string?
ScoreboardTeam: id long, name string, conference string?, classification string?, points long?, line_scores array<long>?, win_probability double?
ScoreboardWeather: temperature double?, description string?, wind_speed double?, wind_direction double?
ScoreboardBetting: spread double?, over_under double?, home_moneyline double?, away_moneyline double?
ScoreboardGame: id long, start_date timestamp, start_time_tbd boolean, tv string?, neutral_site boolean, conference_game boolean, status string,
  period long?, clock string?, situation string?, possession string?, last_play string?, venue ScoreboardVenue, home_team ScoreboardTeam,
  away_team ScoreboardTeam, weather ScoreboardWeather, betting ScoreboardBetting
TeamGameStat: category string, stat string
TeamGameStatsTeam: team_id long, team string, conference string?, home_away string, points long?, stats array<TeamGameStat>
TeamGameStats: id long, teams array<TeamGameStatsTeam>
PlayerGameStatPlayer: id string, name string, stat string
PlayerGameStatType: name string, athletes array<PlayerGameStatPlayer>
PlayerGameStatCategory: name string, types array<PlayerGameStatType>
PlayerGameStatsTeam: team string, conference string?, home_away string, points long?, categories array<PlayerGameStatCategory>
PlayerGameStats: id long, teams array<PlayerGameStatsTeam>
StatsByQuarter: total double, quarter1 double?, quarter2 double?, quarter3 double?, quarter4 double?
TeamPPA: team string, plays long, overall StatsByQuarter, passing StatsByQuarter, rushing StatsByQuarter
TeamSuccessRates: team string, overall StatsByQuarter, standard_downs StatsByQuarter, passing_downs StatsByQuarter
TeamExplosiveness: team string, overall StatsByQuarter
TeamRushingStats: team string, power_success double, stuff_rate double, line_yards double, line_yards_average double, second_level_yards double,
  second_level_yards_average double, open_field_yards double, open_field_yards_average double
TeamHavoc: team string, total double, front_seven double, defensive_back double
TeamScoringOpportunities: team string, opportunities long, points long, points_per_opportunity double
TeamFieldPosition: team string, average_start double, average_starting_predicted_points double
PlayerStatsByQuarter: +StatsByQuarter, rushing double, passing double
PlayerGameUsage: +PlayerStatsByQuarter, player string, team string, position string
PlayerPPA: player string, team string, position string, average PlayerStatsByQuarter, cumulative PlayerStatsByQuarter
AdvancedGameInfo: home_team string, home_points long, home_win_probability double, away_team string, away_points long, away_win_probability double,
  home_winner boolean, excitement double
AdvancedTeamStats: ppa array<TeamPPA>, cumulative_ppa array<TeamPPA>, success_rates array<TeamSuccessRates>, explosiveness array<TeamExplosiveness>,
  rushing array<TeamRushingStats>, havoc array<TeamHavoc>, scoring_opportunities array<TeamScoringOpportunities>,
  field_position array<TeamFieldPosition>
AdvancedPlayerStats: usage array<PlayerGameUsage>, ppa array<PlayerPPA>
AdvancedBoxScore: game_info AdvancedGameInfo, teams AdvancedTeamStats, players AdvancedPlayerStats
# info
UserFeatureAccess: adjusted_metrics boolean, weather boolean, scoreboard boolean, live_play_by_play boolean, graph_ql boolean
UserInfo: patron_level long, tier_name string, monthly_limit long?, remaining_calls long?, used_calls long?, reset_at timestamp, shared_pool boolean,
  products array<string>, features UserFeatureAccess
UserUsageWindow: start timestamp, end timestamp
UserUsageTotals: requests long, cfb_requests long, cbb_requests long, unique_endpoints long
UserUsageEndpoint: api string, endpoint string, requests long, last_used_at timestamp
UserUsageRecentRequest: api string, endpoint string, requested_at timestamp
UserUsage: window UserUsageWindow, api string, totals UserUsageTotals, top_endpoints array<UserUsageEndpoint>,
  recent_requests array<UserUsageRecentRequest>
# metrics
PredictedPointsValue: yard_line long, predicted_points double
TeamPPACumulative: total double, passing double, rushing double
TeamSeasonPPAUnit: overall double, passing double, rushing double, first_down double, second_down double, third_down double,
  cumulative TeamPPACumulative
TeamSeasonPredictedPointsAdded: season long, conference string, team string, offense TeamSeasonPPAUnit, defense TeamSeasonPPAUnit
TeamGamePPAUnit: overall double, passing double, rushing double, first_down double, second_down double, third_down double
TeamGamePredictedPointsAdded: game_id long, season long, week long, season_type string, team string, conference string, opponent string,
  offense TeamGamePPAUnit, defense TeamGamePPAUnit
PlayerGamePPAAverage: all double, passing double?, rush double?
PlayerGamePredictedPointsAdded: season long, week long, season_type string, id string, name string, position string, team string, opponent string,
  average_ppa PlayerGamePPAAverage
PlayerSeasonPPASplit: all double, passing double?, rush double?, first_down double?, second_down double?, third_down double?, standard_downs double?,
  passing_downs double?
PlayerSeasonPredictedPointsAdded: season long, id string, name string, position string, team string, conference string,
  average_ppa PlayerSeasonPPASplit, total_ppa PlayerSeasonPPASplit
PlayWinProbability: game_id long, play_id string, play_text string, home_id long, home string, away_id long, away string, spread double,
  home_ball boolean, home_score long, away_score long, yard_line long, down long, distance long, home_win_probability double, play_number long
PregameWinProbability: season long, season_type string, week long, game_id long, home_team string, away_team string, spread double,
  home_win_probability double
FieldGoalExpectedPoints: yards_to_goal long, distance long, expected_points double
# players
PlayerSearchTeamStint: team string, start_year long?, end_year long?
PlayerSearchResult: id string, team string, name string, first_name string?, last_name string?, weight long?, height double?, jersey long?,
  position string, hometown string, team_color string, team_color_secondary string, active_start_year long?, active_end_year long?,
  team_stints array<PlayerSearchTeamStint>
PlayerUsageSplit: overall double?, passing double?, rush double?, first_down double?, second_down double?, third_down double?,
  standard_downs double?, passing_downs double?
PlayerUsage: season long, id string, name string, position string, team string, conference string, usage PlayerUsageSplit
PlayerSeasonOverviewStat: name string, value string
PlayerSeasonOverviewCategory: name string, stats array<PlayerSeasonOverviewStat>
PlayerSeasonOverviewBoxScore: categories array<PlayerSeasonOverviewCategory>
PlayerSeasonOverviewPPA: average PlayerSeasonPPASplit, total PlayerSeasonPPASplit
PlayerSeasonOverview: season long, id string, name string, position string, team string, conference string, games long,
  box_score_stats PlayerSeasonOverviewBoxScore, usage PlayerUsageSplit?, ppa PlayerSeasonOverviewPPA?
ReturningProduction: season long, team string, conference string, total_ppa double, total_passing_ppa double, total_receiving_ppa double,
  total_rushing_ppa double, percent_ppa double, percent_passing_ppa double, percent_receiving_ppa double, percent_rushing_ppa double, usage double,
  passing_usage double, receiving_usage double, rushing_usage double
PlayerTransfer: season long, first_name string, last_name string, position string, origin string, destination string?, transfer_date timestamp?,
  rating double?, stars long?, eligibility string?
# playoffs
PlayoffTeam: id long, school string, conference string?
PlayoffParticipant: team PlayoffTeam, committee_rank long?, seed long, bid_type string, qualification_reason string?, conference_champion boolean,
  qualifying_conference string?, first_round_bye boolean, outcome string, eliminated_round string?
PlayoffMatchupSlotSource: matchup_id long, bracket_slot string, outcome string
PlayoffMatchupSlot: position long, seed long?, participant PlayoffTeam?, source PlayoffMatchupSlotSource?
PlayoffLinkedGame: id long, start_date timestamp, completed boolean, home_team PlayoffTeam, home_points long?, away_team PlayoffTeam,
  away_points long?, venue_id long?, venue string?
PlayoffAdvancement: matchup_id long, bracket_slot string, position long
PlayoffMatchup: id long, bracket_slot string, round string, round_name string, round_order long, matchup_order long, start_date timestamp?,
  bowl_name string?, slots array<PlayoffMatchupSlot>, game PlayoffLinkedGame?, advances_to PlayoffAdvancement?
PlayoffRoundRecord: code string, name string, order long, matchups array<PlayoffMatchup>
CfpPlayoff: season long, competition string, format string, team_count long, status string, participants array<PlayoffParticipant>,
  rounds array<PlayoffRoundRecord>, champion PlayoffTeam?
# plays
PlayClock: minutes long?, seconds long?
Play: id string, drive_id string, game_id long, drive_number long?, play_number long?, offense string, offense_conference string?,
  offense_score long, defense string, home string, away string, defense_conference string?, defense_score long, period long, clock PlayClock,
  offense_timeouts long?, defense_timeouts long?, yardline long, yards_to_goal long, down long, distance long, yards_gained long, scoring boolean,
  play_type string, play_text string?, ppa double?, wallclock timestamp?
PlayType: id long, text string, abbreviation string?
PlayStat: game_id long, season long, week long, team string, conference string, opponent string, team_score long, opponent_score long,
  drive_id string, play_id string, period long, clock PlayClock, yards_to_goal long, down long, distance long, athlete_id string,
  athlete_name string, stat_type string, stat long
PlayStatType: id long, name string
LiveGamePlay: id string, home_score long, away_score long, period long, clock string?, wall_clock timestamp, team_id long, team string, down long,
  distance long, yards_to_goal long, yards_gained long, play_type_id long, play_type string, epa double?, garbage_time boolean, success boolean,
  rush_pass string, down_type string, play_text string
LiveGameDrive: id string, offense_id long, offense string, defense_id long, defense string, play_count long, yards long, start_period long,
  start_clock string?, start_yards_to_goal long, end_period long?, end_clock string?, end_yards_to_goal long?, duration string?,
  scoring_opportunity boolean, result string, points_gained long, plays array<LiveGamePlay>
LiveGameTeam: team_id long, team string, home_away string, line_scores array<long>, points long, drives long, scoring_opportunities long,
  points_per_opportunity double, average_start_yard_line double?, plays long, line_yards double, line_yards_per_rush double,
  second_level_yards double, second_level_yards_per_rush double, open_field_yards double, open_field_yards_per_rush double, epa_per_play double,
  total_epa double, passing_epa double, epa_per_pass double, rushing_epa double, epa_per_rush double, success_rate double,
  standard_down_success_rate double, passing_down_success_rate double, explosiveness double, deserve_to_win double?
LiveGame: id long, status string, period long?, clock string, possession string, down long?, distance long?, yards_to_goal long?,
  teams array<LiveGameTeam>, drives array<LiveGameDrive>
# rankings
PollRank: rank long?, team_id long, school string, conference string?, first_place_votes long?, points long?
Poll: poll string, is_final boolean?, ranks array<PollRank>
PollWeek: season long, season_type string, week long, polls array<Poll>
# ratings
TeamCoreRating: year long, through_season_type string, through_week long, team string, conference string?, overall double, offense double,
  defense double, offense_plays long, defense_plays long, model_version string
SPHavoc: total double?, front_seven double?, db double?
SPOffense: ranking long?, rating double, success double?, explosiveness double?, rushing double?, passing double?, standard_downs double?,
  passing_downs double?, run_rate double?, pace double?
SPDefense: ranking long?, rating double, success double?, explosiveness double?, rushing double?, passing double?, standard_downs double?,
  passing_downs double?, havoc SPHavoc
SPSpecialTeams: rating double?
TeamSP: year long, team string, conference string?, rating double, ranking long?, second_order_wins double?, sos double?, offense SPOffense,
  defense SPDefense, special_teams SPSpecialTeams
ConferenceSPOffense: rating double, success double?, explosiveness double?, rushing double?, passing double?, standard_downs double?,
  passing_downs double?, run_rate double?, pace double?
ConferenceSPDefense: rating double, success double?, explosiveness double?, rushing double?, passing double?, standard_downs double?,
  passing_downs double?, havoc SPHavoc
ConferenceSP: year long, conference string, rating double, second_order_wins double?, sos double?, offense ConferenceSPOffense,
  defense ConferenceSPDefense, special_teams SPSpecialTeams
TeamSRS: year long, team string, conference string?, division string?, rating double, ranking long?
ExpandedTeamSRS: +TeamSRS, classification string
TeamElo: year long, team string, conference string, elo long?
FPIResumeRanks: strength_of_record long?, fpi long?, average_win_probability long?, strength_of_schedule long?, remaining_strength_of_schedule long?,
  game_control long?
FPIEfficiencies: overall double?, offense double?, defense double?, special_teams double?
TeamFPI: year long, team string, conference string?, fpi double?, resume_ranks FPIResumeRanks, efficiencies FPIEfficiencies
# recruiting
RecruitHometown: latitude double?, longitude double?, fips_code string?
Recruit: id string, athlete_id string?, recruit_type string, year long, ranking long?, name string, school string?, committed_to string?,
  position string?, height double?, weight long?, stars long?, rating double?, city string?, state_province string?, country string?,
  hometown_info RecruitHometown
TeamRecruitingRanking: year long, rank long, team string, points double
AggregatedTeamRecruiting: team string, conference string, position_group string?, average_rating double, total_rating double, commits long,
  average_stars double
# stats
PlayerStat: season long, player_id string, player string, position string, team string, conference string, category string, stat_type string,
  stat string
PlayerSuccessRateSplit: plays long, successes long, success_rate double?
PlayerSeasonSuccessRate: season long, id string, name string, position string, team string, conference string, passing PlayerSuccessRateSplit,
  rushing PlayerSuccessRateSplit
PlayerGameSuccessRate: season long, season_type string, week long, game_id long, id string, name string, position string, team string,
  conference string, opponent string, passing PlayerSuccessRateSplit, rushing PlayerSuccessRateSplit
TeamStat: season long, team string, conference string, stat_name string, stat_value scalar
StatCategory: category string
FieldPosition: average_start double?, average_predicted_points double?
Havoc: total double?, front_seven double?, db double?
SeasonDownStats: rate double, ppa double, success_rate double, explosiveness double?
SeasonPassingDownStats: +SeasonDownStats, total_ppa double
SeasonPlayStats: rate double, ppa double, total_ppa double, success_rate double, explosiveness double?
AdvancedSeasonOffense: plays long, drives long, ppa double, total_ppa double, success_rate double, explosiveness double?, power_success double?,
  stuff_rate double, line_yards double, line_yards_total long, second_level_yards double, second_level_yards_total long, open_field_yards double,
  open_field_yards_total long, total_opportunities long, points_per_opportunity double, field_position FieldPosition, havoc Havoc,
  standard_downs SeasonDownStats, passing_downs SeasonDownStats, rushing_plays SeasonPlayStats, passing_plays SeasonPlayStats
AdvancedSeasonDefense: +AdvancedSeasonOffense, passing_downs SeasonPassingDownStats
AdvancedSeasonStat: season long, team string, conference string, offense AdvancedSeasonOffense, defense AdvancedSeasonDefense
GameDownStats: ppa double, success_rate double, explosiveness double?
GamePlayStats: ppa double, total_ppa double, success_rate double, explosiveness double?
_AdvancedGameUnit: plays long, drives long, ppa double, total_ppa double, success_rate double, explosiveness double?, power_success double?,
  stuff_rate double, line_yards double, line_yards_total long, second_level_yards double, second_level_yards_total long, open_field_yards double?,
  open_field_yards_total long?, standard_downs GameDownStats, passing_downs GameDownStats, rushing_plays GamePlayStats, passing_plays GamePlayStats
AdvancedGameOffense: +_AdvancedGameUnit, open_field_yards_total long
AdvancedGameDefense: +_AdvancedGameUnit, explosiveness double, open_field_yards double, open_field_yards_total long?
AdvancedGameStat: game_id long, season long, season_type string, week long, team string, opponent string, offense AdvancedGameOffense,
  defense AdvancedGameDefense
GameHavocUnit: total_plays double, total_havoc_events double, front_seven_havoc_events double, db_havoc_events double, havoc_rate double,
  front_seven_havoc_rate double, db_havoc_rate double
GameHavocStats: game_id long, season long, season_type string, week long, team string, conference string?, opponent string,
  opponent_conference string?, offense GameHavocUnit, defense GameHavocUnit
# teams
Team: id long, school string, mascot string?, abbreviation string?, alternate_names array<string>?, conference string?, division string?,
  classification string?, color string?, alternate_color string?, logos array<string>?, twitter string?, location Venue?
MatchupGame: season long, week long, season_type string, date timestamp, neutral_site boolean, venue string?, home_team string, home_score long?,
  away_team string, away_score long?, winner string?
Matchup: team1 string, team2 string, start_year long?, end_year long?, team1_wins long, team2_wins long, ties long, games array<MatchupGame>
RosterPlayer: id string, first_name string, last_name string, team string, height double?, weight long?, jersey long?, year long, position string?,
  home_city string?, home_state string?, home_country string?, home_latitude double?, home_longitude double?, home_county_fips string?,
  recruit_ids array<string>?
TeamTalent: year long, team string, talent double
TeamATS: year long, team_id long, team string, conference string?, games long, ats_wins long, ats_losses long, ats_pushes long,
  avg_cover_margin double?
# venues
Venue: id long?, name string?, city string?, state string?, zip string?, country_code string?, timezone string?, latitude double?, longitude double?,
  elevation string?, capacity long?, construction_year long?, grass boolean?, dome boolean?
"""

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "scalar": TAGGED_SCALAR}


@cache
def _table() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    name = ""
    for line in MODELS.splitlines():
        if not line or line.startswith("#"):
            continue
        if not line.startswith(" "):
            name, line = line.split(": ", 1)
            found[name] = []
        found[name] += [c.strip() for c in line.split(",") if c.strip()]
    return found


def names() -> list[str]:
    return list(_table())


def typed(kind: str) -> T.DataType:
    """The type that a word of the table stands for: a simple type, a model, or array<...> of either."""
    if kind.startswith("array<"):
        return T.ArrayType(typed(kind[6:-1]))
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in model(kind)])  # within a column all may be null, as readers make it


@cache
def model(name: str) -> T.StructType:
    """The schema of a model's rows."""
    if name not in _table():
        raise ContractError(f"no such model: {name}")
    return schema(_table()[name])


def schema(columns: list[str]) -> T.StructType:
    """A schema from words such as "id long", "team string?" and "+Model"."""
    fields: dict[str, T.StructField] = {}
    for c in columns:
        if c.startswith("+"):
            fields |= {f.name: f for f in model(c[1:])}
        else:
            n, kind = c.split(" ", 1)
            fields[n] = T.StructField(n, typed(kind.rstrip("?")), kind.endswith("?"))
    return T.StructType(list(fields.values()))


#: Models by the names that products use.
BETTING_GAME, POLL_WEEK, DRIVE, PLAY = model("BettingGame"), model("PollWeek"), model("Drive"), model("Play")
WIN_PROBABILITY, CLASS_RANKING, RECRUIT = model("PlayWinProbability"), model("TeamRecruitingRanking"), model("Recruit")
ROSTER_PLAYER, COACH_TENURE = model("RosterPlayer"), model("CoachTenure")


def row(columns: str, optional: str = "") -> T.StructType:
    """A schema of one's own from "name type, ..." without a session, whose columns are non-null but for those named in `optional`."""
    may = set(optional.split())
    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]
    return T.StructType([T.StructField(n, _SIMPLE["long" if k == "bigint" else k], n in may) for n, k in pairs])
