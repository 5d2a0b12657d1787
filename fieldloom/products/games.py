"""Products about games: summaries with media and weather, and the statistics of players in games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.functions.text import folded_text
from fieldloom.operators import joins
from fieldloom.sources.json_pages import ORDINAL


def _scored() -> Column:
    return F.col("completed") & F.col("home_points").isNotNull() & F.col("away_points").isNotNull()


def game_summaries(games: DataFrame, media: DataFrame | None = None, weather: DataFrame | None = None, media_game_id: int | None = None) -> DataFrame:
    """Games with their result, where completed and scored, and the asked-for enrichments with their coverage.

    media and weather must be about these games and agree with them in season, week, time, teams and conferences where
    both tell them; weather in the venue too. media needs source_ordinal: a game's media are a list in that order.
    media_game_id keeps the media of one game out of a wider page before they are checked.
    """
    home, away = F.col("home_points"), F.col("away_points")
    out = games.select(F.col("id").alias("game_id"), *[c for c in games.columns if c not in ("id", ORDINAL)])
    won = F.when(home > away, "home_win").when(home < away, "away_win").otherwise("tie")
    out = out.withColumns(
        {
            "result_state": F.when(_scored(), won),
            "total_points": F.when(_scored(), home + away),
            "margin": F.when(_scored(), F.abs(home - away)),
            "winner_id": F.when(_scored() & (home > away), F.col("home_id")).when(_scored() & (home < away), F.col("away_id")),
            "loser_id": F.when(_scored() & (home > away), F.col("away_id")).when(_scored() & (home < away), F.col("home_id")),
        }
    )
    out = _with_media(out, media, media_game_id)
    if weather is None:
        return out.withColumns({"weather_coverage": F.lit("not_requested"), "weather": F.lit(None)})
    w = weather.drop(ORDINAL)
    w = w.select(F.col("id").alias("game_id"), F.struct(*w.columns).alias("weather"))
    venue = (F.col("weather.venue_id") != F.col("venue_id")) | (F.col("weather.venue") != F.col("venue"))
    return joins.enrich_left(out, w, ["game_id"], coverage="weather_coverage", conflict=_disagrees("weather") | F.coalesce(venue, F.lit(False)))


def _with_media(out: DataFrame, media: DataFrame | None, game_id: int | None) -> DataFrame:
    if media is None:
        return out.withColumns({"media_coverage": F.lit("not_requested"), "media": F.lit(None)})
    m = media if game_id is None else media.where(F.col("id") == game_id)
    checks.keys_unique(m, ["id", "media_type", "outlet"])
    m = m.select(F.col("id").alias("game_id"), ORDINAL, F.struct(*[c for c in m.columns if c != ORDINAL]).alias("item"))
    checks.none_where(out.join(m, "game_id"), _disagrees("item"), "media disagree with their game")
    got = joins.enrich_collect(out, m, ["game_id"], ordinal=ORDINAL, into="media", coverage="media_coverage")
    return got.withColumn("media", F.transform("media", lambda x: x["item"]))


def _disagrees(item: str) -> Column:
    """True where an enrichment tells another context than the game it is joined to."""
    x = lambda c: F.col(f"{item}.{c}")
    no = lambda c: F.coalesce(c, F.lit(False))
    bad = no(x("start_time") != F.col("start_date"))
    for c in ("season", "week", "season_type"):
        bad = bad | no(x(c) != F.col(c))
    for side in ("home", "away"):
        bad = bad | no(folded_text(x(f"{side}_team")) != folded_text(F.col(f"{side}_team"))) | no(x(f"{side}_conference") != F.col(f"{side}_conference"))
    return bad


def player_game_stats(summaries: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for each athlete's statistic, with the places of its category, type and athlete in their lists.

    Team ids and classifications come from the game's side. Every game of stats must be among the summaries.
    """
    sides = [F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"{s}_classification").alias("classification")).alias(s) for s in ("home", "away")]
    about = summaries.select("game_id", "season", "week", "season_type", "start_date", *sides)
    checks.keys_unique(about, ["game_id"])
    games = stats.select(F.col("id").alias("game_id"), "teams")
    checks.within_universe(games, about, ["game_id"])
    x = games.select("game_id", F.explode("teams").alias("t"))
    x = x.select("game_id", *[f"t.{c}" for c in ("team", "conference", "home_away")], F.col("t.points").alias("team_points"), F.posexplode("t.categories").alias("category_ordinal", "c"))
    keep = [c for c in x.columns if c != "c"]
    x = x.select(*keep, F.col("c.name").alias("category"), F.posexplode("c.types").alias("stat_type_ordinal", "k"))
    keep = [c for c in x.columns if c != "k"]
    x = x.select(*keep, F.col("k.name").alias("stat_type"), F.posexplode("k.athletes").alias("athlete_ordinal", "a"))
    at_home = F.col("home_away") == "home"
    own = F.when(at_home, F.col("home")).otherwise(F.col("away"))
    return x.join(about, "game_id").select(
        "game_id", "season", "week", "season_type", "start_date", own["team_id"].alias("team_id"), "team", "conference", own["classification"].alias("classification"),
        "home_away", F.when(at_home, 0).otherwise(1).cast("long").alias("team_ordinal"), "team_points", F.col("a.id").alias("athlete_id"), F.col("a.name").alias("athlete_name"),
        "category", "stat_type", F.col("a.stat").alias("stat"), *[F.col(f"{c}_ordinal").cast("long").alias(f"{c}_ordinal") for c in ("category", "stat_type", "athlete")],
    )


#: Keys and order of each product; orders put nulls last.
CONTRACTS = {
    "game_summaries": (["game_id"], ["season", "week", "game_id"]),
    "player_game_stats": (["game_id", "team_id", "athlete_id", "category", "stat_type"], ["season", "week", "game_id", "team_ordinal", "category_ordinal", "stat_type_ordinal", "athlete_ordinal"]),
}
