"""Seasons of teams and of players: a base that one source (or two) sets, and what other sources know about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.functions.text import folded_text, join_words
from fieldloom.operators import joins, state
from fieldloom.sources import rows
from fieldloom.sources.json_pages import ORDINAL

#: Enrichments of a team's season: (column, model, how it is joined).
TEAM_ENRICHMENTS = (
    ("ppa", "TeamSeasonPredictedPointsAdded", {"season": "season", "outside": "error", "conference": "equal"}),
    ("talent", "TeamTalent", {}),
    ("ats", "TeamATS", {"by_id": True, "conference": "unless_null"}),
    ("returning_production", "ReturningProduction", {"season": "season", "outside": "error", "conference": "equal"}),
    ("core_rating", "TeamCoreRating", {"conference": "unless_null"}),
    ("sp_rating", "TeamSP", {"conference": "unless_null"}),
    ("srs_rating", "TeamSRS", {"conference": "unless_null"}),
    ("elo_rating", "TeamElo", {"conference": "unless_null"}),
    ("fpi_rating", "TeamFPI", {"conference": "unless_null"}),
    ("adjusted_metrics", "AdjustedTeamMetrics", {"by_id": True, "conference": "equal"}),
)
#: Enrichments of a player's season: (column, model, its names of season and athlete).
PLAYER_ENRICHMENTS = (
    ("usage", "PlayerUsage", "season", "id"), ("ppa", "PlayerSeasonPredictedPointsAdded", "season", "id"), ("success", "PlayerSeasonSuccessRate", "season", "id"),
    ("passing_wepa", "PlayerWeightedEPA", "year", "athlete_id"), ("rushing_wepa", "PlayerWeightedEPA", "year", "athlete_id"), ("kicker_paar", "KickerPAAR", "year", "athlete_id"),
)
_RECORD = ("classification", "conference", "division", "expected_wins", "total", "conference_games", "home_games", "away_games", "neutral_site_games", "regular_season", "postseason")
TEAM_KEYS, PLAYER_KEYS = ["season", "team_id"], ["season", "source_team", "athlete_id"]


def _enriched(out: DataFrame, other: DataFrame | None, into: str, kind: str, *, season: str = "year", by_id: bool = False, outside: str = "ignore", conference: str = "") -> DataFrame:
    """One enrichment by (season, folded name) or (season, team id). Any row at all means that the whole base must be covered."""
    coverage = f"{into}_coverage"
    if other is None:
        return out.withColumns({coverage: F.lit("not_requested"), into: F.lit(None).cast(rows.model(kind))})
    o = other.drop(ORDINAL)
    on = F.col("team_id") if by_id else folded_text(F.col("team"))
    keys = ["season", "team_id" if by_id else "_name"]
    got = joins.attach(out, o.select(F.col(season).alias("season"), on.alias(keys[1]), F.struct(*o.columns).alias(into)), keys, into=into, outside=outside, label=into)
    x = lambda c: F.col(f"{into}.{c}")
    there = F.col(into).isNotNull()
    rules = []
    if by_id:
        rules.append((there & (folded_text(x("team")) != F.col("_name")), f"{into}: another team's name"))
    if conference:
        differs = ~x("conference").eqNullSafe(F.col("conference"))
        rules.append((there & differs & (F.lit(True) if conference == "equal" else x("conference").isNotNull()), f"{into}: another conference"))
    if not other.isEmpty():
        rules.append((~there, f"{into}: incomplete"))
    return checks.guarded(got, *rules).withColumn(coverage, F.when(there, "present").otherwise("empty"))


def team_seasons(records: DataFrame, statistics: DataFrame, advanced: DataFrame, **enrichments: DataFrame | None) -> DataFrame:
    """A row for each team and season of the records, which statistics and advanced metrics must cover.

    statistics needs source_ordinal: a team's are one list in that order, of some tens. Statistics, talent, ratings,
    ATS and adjusted metrics of other teams are left out; PPA and returning production of other teams fail the query.
    """
    if unknown := set(enrichments) - {n for n, *_ in TEAM_ENRICHMENTS}:
        raise TypeError(f"no such enrichments: {sorted(unknown)}")
    base = records.select(F.col("year").alias("season"), "team_id", "team", *_RECORD, folded_text(F.col("team")).alias("_name"))
    same = F.count("*").over(Window.partitionBy("season", "_name"))
    base = checks.guarded(base.withColumn("_n", same), (F.col("_n") > 1, "records name a team twice in a season")).drop("_n")
    s = statistics.select("season", folded_text(F.col("team")).alias("_name"), F.struct(
        F.col(ORDINAL).alias("at"), F.col("stat_name").alias("name"), F.col("stat_value").alias("value"), F.col("conference").alias("source_conference")).alias("s"))
    s = s.groupBy("season", "_name").agg(F.array_sort(F.collect_list("s")).alias("_s"))
    out = base.join(s, ["season", "_name"], "left")
    twice = F.size(F.array_distinct(F.transform("_s", lambda x: x["name"]))) < F.size("_s")
    out = checks.guarded(out, (F.col("_s").isNull(), "statistics don't cover the records"), (twice, "statistics name one twice"))
    item = lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["source_conference"].alias("source_conference"), x["at"].alias(ORDINAL))
    out = out.withColumn("statistics", F.transform("_s", item)).drop("_s")
    a = advanced.drop(ORDINAL)
    a = a.select("season", folded_text(F.col("team")).alias("_name"), F.struct(*a.columns).alias("advanced"))
    out = joins.attach(out, a, ["season", "_name"], into="advanced", outside="ignore", label="advanced statistics")
    out = checks.guarded(out, (F.col("advanced").isNull(), "advanced statistics don't cover the records"))
    for name, kind, how in TEAM_ENRICHMENTS:
        out = _enriched(out, enrichments.get(name), name, kind, **how)
    return out.select("season", "team_id", "team", *_RECORD, "statistics", "advanced", *[c for n, *_ in TEAM_ENRICHMENTS for c in (f"{n}_coverage", n)])


def player_seasons(season: int, memberships: DataFrame, statistics: DataFrame, teams: DataFrame, **enrichments: DataFrame | None) -> DataFrame:
    """The union of a season's roster members and of the athletes with statistics, by (folded team, athlete).

    A member's name, position and team text win over those of the statistics. statistics needs source_ordinal; an
    athlete's are one list in that order. Enrichments may cover athletes in part, but none may be about another.
    """
    if unknown := set(enrichments) - {n for n, *_ in PLAYER_ENRICHMENTS}:
        raise TypeError(f"no such enrichments: {sorted(unknown)}")
    key = ["_team", "athlete_id"]
    r = memberships.select(folded_text(F.col("source_team")).alias("_team"), "athlete_id", F.struct(*memberships.columns).alias("roster"))
    r = r.groupBy(*key).agg(F.first("roster").alias("roster"), F.count("*").alias("_members"))
    s = checks.guarded(statistics, (~F.col("season").eqNullSafe(F.lit(season)), "a player's statistic is of another season"))
    about = F.struct(F.col("player").alias("name"), "position")
    stat = F.struct(F.col(ORDINAL).alias("at"), "category", "stat_type", "stat", F.col("conference").alias("source_conference"))
    s = s.select(folded_text(F.col("team")).alias("_team"), F.col("player_id").alias("athlete_id"), "team", about.alias("who"), stat.alias("s"))
    s = s.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("_s"), F.min("who").alias("who"), F.max("who").alias("_other"), F.min_by("team", "s.at").alias("team"))
    out = r.join(s, key, "full_outer")
    twice = F.size(F.array_distinct(F.transform("_s", lambda x: F.struct(x["category"].alias("c"), x["stat_type"].alias("t"))))) < F.size("_s")
    out = checks.guarded(
        out, (F.col("_members") > 1, "an athlete is on a roster twice"), (F.coalesce(F.col("who") != F.col("_other"), F.lit(False)), "statistics disagree about an athlete"),
        (F.coalesce(twice, F.lit(False)), "a player's statistic is there twice"),
    )
    member = F.col("roster").isNotNull()
    index = state.name_index(teams, entity_id="id", name="school", aliases="alternate_names")
    out = out.withColumn("source_team", F.when(member, F.col("roster.source_team")).otherwise(F.col("team"))).drop("team")
    out = state.resolve_names(out, index, name="source_team")
    item = lambda x: F.struct(x["category"].alias("category"), x["stat_type"].alias("stat_type"), x["stat"].alias("stat"), x["source_conference"].alias("source_conference"), x["at"].alias(ORDINAL))
    lists = F.transform("_s", item)
    empty = F.array().cast(out.select(lists.alias("x")).schema["x"].dataType)
    out = out.withColumns({"season": F.lit(season).cast("long"), "statistics": F.coalesce(lists, empty)})
    for name, kind, year, athlete in PLAYER_ENRICHMENTS:
        out = _player_enriched(out, enrichments.get(name), name, kind, year, athlete, season)
    name: Column = F.when(member, join_words(F.col("roster.first_name"), F.col("roster.last_name"))).otherwise(F.col("who.name"))
    return out.select(
        "season", "source_team", F.col("entity_id").alias("team_id"), F.col("resolution").alias("team_identity_status"), F.col("candidate_ids").alias("team_identity_candidate_ids"),
        "athlete_id", name.alias("athlete_name"), F.when(member, F.col("roster.position")).otherwise(F.col("who.position")).alias("position"),
        member.alias("roster_present"), F.col("_s").isNotNull().alias("statistics_present"), "roster", "statistics",
        *[c for n, *_ in PLAYER_ENRICHMENTS for c in (f"{n}_coverage", n)],
    )


def _player_enriched(out: DataFrame, other: DataFrame | None, into: str, kind: str, year: str, athlete: str, season: int) -> DataFrame:
    coverage = f"{into}_coverage"
    if other is None:
        return out.withColumns({coverage: F.lit("not_requested"), into: F.lit(None).cast(rows.model(kind))})
    o = checks.guarded(other.drop(ORDINAL), (~F.col(year).eqNullSafe(F.lit(season)), f"{into}: another season"))
    o = o.select(folded_text(F.col("team")).alias("_team"), F.col(athlete).alias("athlete_id"), F.struct(*o.columns).alias(into))
    got = joins.attach(out, o, ["_team", "athlete_id"], into=into, outside="error", label=into)
    return got.withColumn(coverage, F.when(F.col(into).isNotNull(), "present").otherwise("empty"))
