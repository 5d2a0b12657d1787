"""Products that flatten or normalise one source, or enrich it by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import ContractError
from fieldloom.functions.text import clock_seconds, folded_text
from fieldloom.operators import joins, nested, state
from fieldloom.sources.json_pages import ORDINAL


def betting_lines(games: DataFrame) -> DataFrame:
    """A row for each quote of each game; games without quotes give none."""
    base = [c for c in games.columns if c not in ("id", "lines", ORDINAL)]
    each = nested.explode_list(games.select(F.col("id").alias("game_id"), *base, "lines"), field="lines", empty_list="drop", ordinal_field="source_ordinal")
    rest = [f.name for f in games.schema["lines"].dataType.elementType if f.name != "provider"]
    return each.select("game_id", *base, "lines.provider", "source_ordinal", *[f"lines.{c}" for c in rest])


def poll_rankings(weeks: DataFrame) -> DataFrame:
    """A row for each team of each poll of each week, with the places of both in their lists."""
    polls = nested.explode_list(weeks.select("season", "season_type", "week", "polls"), field="polls", empty_list="drop", ordinal_field="poll_ordinal")
    polls = polls.select("season", "season_type", "week", "polls.poll", "polls.is_final", "poll_ordinal", F.col("polls.ranks").alias("r"))
    ranks = nested.explode_list(polls, field="r", empty_list="drop", ordinal_field="rank_ordinal")
    return ranks.select(
        "season", "season_type", "week", "poll", "is_final", "r.team_id", "r.school", "r.conference", "r.rank", "r.first_place_votes", "r.points", "poll_ordinal", "rank_ordinal"
    )


def _one_game(rows: DataFrame, game_id: int | None) -> DataFrame:
    return rows if game_id is None else rows.where(F.col("game_id") == game_id)


def drives(rows: DataFrame, game_id: int | None = None) -> DataFrame:
    """Drives with their clocks in seconds and the change of both scores."""
    seconds = lambda c: clock_seconds(F.col(f"{c}.minutes"), F.col(f"{c}.seconds"))
    change = lambda side: F.col(f"end_{side}_score") - F.col(f"start_{side}_score")
    kept = [F.col(c).alias("drive_id" if c == "id" else c) for c in rows.columns if c != ORDINAL]
    return _one_game(rows, game_id).select(
        *kept,
        seconds("start_time").alias("start_clock_seconds"), seconds("end_time").alias("end_clock_seconds"), seconds("elapsed").alias("elapsed_seconds"),
        change("offense").alias("offense_score_change"), change("defense").alias("defense_score_change"),
    )


def plays(rows: DataFrame, game_id: int | None = None, probabilities: DataFrame | None = None) -> DataFrame:
    """Plays with their clock in seconds; with probabilities, which must cover one game's plays exactly."""
    kept = [F.col(c).alias("play_id" if c == "id" else c) for c in rows.columns if c != ORDINAL]
    out = _one_game(rows, game_id).select(*kept, clock_seconds(F.col("clock.minutes"), F.col("clock.seconds")).alias("clock_seconds"))
    if probabilities is None:
        return out.withColumn("win_probability_coverage", F.lit("not_requested"))
    if game_id is None:
        raise ContractError("probabilities belong to one game, which must be named")
    p = probabilities.drop(ORDINAL)
    checks.none_where(p, ~F.col("game_id").eqNullSafe(F.lit(game_id)), "a probability is of another game")
    checks.keys_unique(out, ["play_id"])
    p = p.select("play_id", F.struct(*p.columns).alias("win_probability"))
    checks.within_universe(p, out, ["play_id"])
    return joins.require_complete(out, p, ["play_id"]).withColumn("win_probability_coverage", F.lit("present"))


def rosters(players: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    """Players with the identity of their team: resolved, ambiguous or unresolved, and the candidates."""
    index = state.name_index(teams, entity_id="id", name="school", aliases="alternate_names")
    found = state.resolve_names(players, index, name="team")
    rest = [c for c in players.columns if c not in ("id", "team", "year", "first_name", "last_name", "height", "weight", "jersey", ORDINAL)]
    return found.select(
        F.lit(season).cast("long").alias("season"), F.col("team").alias("source_team"), F.col("entity_id").alias("team_id"),
        F.col("resolution").alias("team_identity_status"), F.col("candidate_ids").alias("team_identity_candidate_ids"), F.col("id").alias("athlete_id"),
        "first_name", "last_name", "height", "weight", "jersey", F.col("year").alias("class_year"), *rest,
    )


def recruiting_classes(rankings: DataFrame, recruits: DataFrame) -> DataFrame:
    """Ranked classes, classes of commitments alone and one bucket of the uncommitted a year, with their recruits in source order.

    recruits needs source_ordinal. A class's recruits are one list by contract: a team signs some tens a year.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("team:"), folded_text(F.col(c)))).otherwise("uncommitted")
    a = rankings.select(F.col("year").alias("class_year"), key("team").alias("class_key"), "team", "rank", "points", F.lit(True).alias("ranked"))
    checks.keys_unique(a, ["class_year", "class_key"])
    checks.keys_unique(recruits, ["id"])
    fields = [c for c in recruits.columns if c != ORDINAL]
    one = F.struct(ORDINAL, F.struct(*fields).alias("recruit"))
    b = recruits.select(F.col("year").alias("class_year"), key("committed_to").alias("class_key"), one.alias("r"))
    b = b.groupBy("class_year", "class_key").agg(F.collect_list("r").alias("r"))
    b = b.select("class_year", "class_key", F.transform(F.array_sort("r", lambda x, y: F.when(x[ORDINAL] < y[ORDINAL], -1).otherwise(1)), lambda x: x["recruit"]).alias("recruits"))
    both = a.join(b, ["class_year", "class_key"], "full_outer")
    uncommitted = F.col("class_key") == "uncommitted"
    both = both.select(
        "class_year", "class_key", F.coalesce("team", F.col("recruits")[0]["committed_to"]).alias("source_team"),
        F.when(uncommitted, "uncommitted").when(F.col("ranked"), "ranked").otherwise("commitments_only").alias("status"),
        "rank", "points", F.coalesce("recruits", F.array().cast(dict(b.dtypes)["recruits"])).alias("recruits"),
    )
    both = both.withColumn("recruit_count", F.size("recruits").cast("long"))
    # ordinals run on over the years: each year is numbered by itself and starts where the years before it end
    years = both.groupBy("class_year").agg(F.count("*").alias("n"))
    start = years.alias("x").join(years.alias("y"), F.col("y.class_year") < F.col("x.class_year"), "left").groupBy("x.class_year").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("class_year").orderBy(F.col("status") == "uncommitted", F.asc_nulls_last("rank"), "class_key"))
    out = both.withColumn("_nth", nth).join(start, "class_year")
    return out.select("class_year", "class_key", (F.col("start") + F.col("_nth") - 1).cast("long").alias("class_ordinal"), "source_team", "status", "rank", "points", "recruits", "recruit_count")


#: A tenure's columns in the product, by the columns of the source.
_TENURE = {
    "id": "tenure_id", "hire_date": "hire_date", "start_year": "tenure_start_year", "end_year": "tenure_end_year", "effective_start": "effective_start",
    "effective_end": "effective_end", "is_interim": "is_interim", "active": "tenure_active", "seasons": "tenure_seasons", "record": "tenure_record",
    "attribution_complete": "tenure_attribution_complete",
}


def coach_seasons(rows: DataFrame, tenures: DataFrame | None = None) -> DataFrame:
    """Seasons of coaches; with tenures, each season must lie in exactly one tenure of its coach and team."""
    rest = [c for c in rows.columns if c not in ("year", "team", "coach", ORDINAL)]
    out = rows.select(
        "year", F.col("team.id").alias("team_id"), "team.school", "team.conference", F.col("coach.id").alias("coach_id"),
        F.col("coach.first_name").alias("coach_first_name"), F.col("coach.last_name").alias("coach_last_name"), *rest,
    )
    if tenures is None:
        return out.withColumn("tenure_coverage", F.lit("not_requested"))
    t = tenures.select(F.col("coach.id").alias("coach_id"), F.col("team.id").alias("team_id"), *[F.col(c).alias(n) for c, n in _TENURE.items()])
    got = joins.range_one(out, t, ["coach_id", "team_id"], value="year", start="tenure_start_year", end="tenure_end_year", id_columns=["year", "team_id", "coach_id"])
    return got.withColumn("tenure_coverage", F.lit("present"))


#: Keys and order of each product; orders put nulls last.
CONTRACTS = {
    "betting_lines": (["game_id", "provider", "source_ordinal"], ["season", "week", "game_id", "source_ordinal"]),
    "poll_rankings": (["season", "season_type", "week", "poll", "team_id"], ["season", "season_type", "week", "poll_ordinal", "rank_ordinal", "team_id"]),
    "drives": (["game_id", "drive_id"], ["game_id", "drive_number", "drive_id"]),
    "plays": (["game_id", "play_id"], ["game_id", "drive_number", "play_number", "play_id"]),
    "rosters": (["season", "source_team", "athlete_id"], ["season", "source_team", "athlete_id"]),
    "recruiting_classes": (["class_year", "class_key"], ["class_year", "class_ordinal"]),
    "coach_seasons": (["year", "team_id", "coach_id"], ["year", "team_id", "coach_id"]),
}
