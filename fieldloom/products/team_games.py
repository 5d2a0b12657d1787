"""Team games: both sides of each game as rows of their own, with the enrichments asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import checks
from fieldloom.errors import ContractError
from fieldloom.functions.text import folded_text
from fieldloom.operators import joins, nested
from fieldloom.sources import rows
from fieldloom.sources.json_pages import ORDINAL

KEYS, ORDER = ["game_id", "team_id"], ["season", "week", "game_id", "perspective_ordinal"]
_GAME = ["game_id", "season", "week", "season_type", "start_date", "completed", "neutral_site", "conference_game", "venue_id", "venue"]
_SIDE = (
    "team_id", "team", "conference", "classification", "home_away", "perspective_ordinal", "opponent_id", "opponent", "opponent_conference",
    "opponent_classification", "points", "opponent_points", "result", "total_points", "margin", "point_differential",
)


def sides(summaries: DataFrame) -> DataFrame:
    """Two rows a game, in one pass: the home side is 0, the away side 1. A result only where the summary has one."""

    def side(own: str, other: str, place: int) -> dict[str, Column]:
        x = F.col
        points, against = x(f"{own}_points"), x(f"{other}_points")
        won = F.when(x("result_state") == "tie", "tie").when(x("winner_id") == x(f"{own}_id"), "win").otherwise("loss")
        columns = [
            x(f"{own}_id"), x(f"{own}_team"), x(f"{own}_conference"), x(f"{own}_classification"), F.lit(own), F.lit(place).cast("long"),
            x(f"{other}_id"), x(f"{other}_team"), x(f"{other}_conference"), x(f"{other}_classification"), points, against,
            F.when(x("result_state").isNotNull(), won), x("total_points"), x("margin"), F.when(x("result_state").isNotNull(), points - against),
        ]
        return dict(zip(_SIDE, columns))

    both = nested.perspectives(summaries, sides=[side("home", "away", 0), side("away", "home", 1)], ordinal="_side", keep=_GAME)
    return both.select(*_GAME, *_SIDE)


def _none(coverage: str, **columns: str) -> dict[str, Column]:
    return {coverage: F.lit("not_requested"), **{c: F.lit(None).cast(rows.typed(kind)) for c, kind in columns.items()}}


def with_team_stats(out: DataFrame, stats: DataFrame) -> DataFrame:
    """Conventional statistics by (game, team): every side must have its own; an empty list is 'empty'."""
    each = stats.select(F.col("id").alias("game_id"), F.explode("teams").alias("t"))
    each = each.select("game_id", F.col("t.team_id").alias("team_id"), F.struct(F.col("t.home_away").alias("side"), F.col("t.stats").alias("stats")).alias("_s"))
    got = joins.attach(out, each, KEYS, into="_s", outside="ignore", label="team statistics")
    got = checks.guarded(got, (F.col("_s").isNull(), "team statistics are incomplete"), (F.col("_s.side") != F.col("home_away"), "team statistics are of the other side"))
    return got.withColumns({"team_stats_coverage": F.when(F.size("_s.stats") > 0, "present").otherwise("empty"), "team_stats": F.col("_s.stats")}).drop("_s")


def with_advanced_box(out: DataFrame, box: DataFrame, game_id: int | None) -> DataFrame:
    """The one box score of the one game, to both of its sides."""
    b = nested.require_one(box.select("game_info"))[0]
    base = out.select("game_id", "home_away", folded_text(F.col("team")).alias("name"), "points").take(3)
    by_side = {r.home_away: r for r in base}
    if game_id is None or len(base) != 2 or {r.game_id for r in base} != {game_id} or set(by_side) != {"home", "away"}:
        raise ContractError("a box score needs both sides of exactly its game")
    for side, r in by_side.items():
        if " ".join(b[f"{side}_team"].split()).casefold() != r.name or r.points not in (None, b[f"{side}_points"]):
            raise ContractError("the box score disagrees with its game")
    whole = F.struct(*[c for c in box.columns if c != ORDINAL]).alias("advanced_box")
    return out.crossJoin(F.broadcast(box.select(whole))).withColumn("advanced_box_coverage", F.lit("present"))  # two rows by one


def required(out: DataFrame, team: str | None) -> DataFrame:
    """Adds _required: the sides that an enrichment must cover, all of them or those of the named team, which every game must have."""
    if team is None:
        return out.withColumn("_required", F.lit(True))
    mark = out.withColumn("_required", F.col("_name") == folded_text(F.lit(team)))
    seen = F.max("_required").over(Window.partitionBy("game_id"))
    return checks.guarded(mark.withColumn("_any", seen), (~F.col("_any"), f"not every game has the team {team!r}")).drop("_any")


def with_units(out: DataFrame, other: DataFrame, prefix: str, coverage: str, team: str | None, *, conference: bool = False, both: bool = False) -> DataFrame:
    """Offense and defense by (game, folded team name): within the base, once, of the same context, and for all required sides or none."""
    o = other.drop(ORDINAL)
    o = o.select("game_id", folded_text(F.col("team")).alias("_name"), F.struct(*o.columns).alias("_o"))
    base = required(out.withColumn("_name", folded_text(F.col("team"))), team)
    got = joins.attach(base, o, ["game_id", "_name"], into="_o", outside="error", label=coverage)
    x = lambda c: F.col(f"_o.{c}")
    there = F.col("_o").isNotNull()
    bad = (x("season") != F.col("season")) | (x("week") != F.col("week")) | (x("season_type") != F.col("season_type")) | (folded_text(x("opponent")) != folded_text(F.col("opponent")))
    rules = [(there & bad, f"{coverage}: another game's context")]
    if conference:
        rules.append((there & F.col("conference").isNotNull() & ~x("conference").eqNullSafe(F.col("conference")), f"{coverage}: another conference"))
    if both:
        rules.append((there & F.col("opponent_conference").isNotNull() & ~x("opponent_conference").eqNullSafe(F.col("opponent_conference")), f"{coverage}: another conference of the opponent"))
    if not other.isEmpty():
        rules.append((F.col("_required") & ~there, f"{coverage}: incomplete"))
    state = F.when(there, "present").when(F.col("_required"), "empty").otherwise("not_requested")
    got = checks.guarded(got, *rules).withColumns({f"{coverage}": state, f"{prefix}_offense": x("offense"), f"{prefix}_defense": x("defense")})
    return got.drop("_o", "_name", "_required")


def team_games(
    summaries: DataFrame, *, statistics: DataFrame | None = None, advanced_box: DataFrame | None = None, advanced_box_game_id: int | None = None, advanced: DataFrame | None = None,
    havoc: DataFrame | None = None, ppa: DataFrame | None = None, requested_team: str | None = None,
) -> DataFrame:
    """A row for each side of each game. An enrichment that wasn't asked for is 'not_requested'; one that is must fit, or the query fails."""
    out = sides(summaries)
    out = out.withColumns(_none("team_stats_coverage", team_stats="array<TeamGameStat>")) if statistics is None else with_team_stats(out, statistics)
    out = out.withColumns(_none("advanced_box_coverage", advanced_box="AdvancedBoxScore")) if advanced_box is None else with_advanced_box(out, advanced_box, advanced_box_game_id)
    for other, prefix, coverage, offense, defense, checked in (
        (advanced, "advanced", "advanced_stats_coverage", "AdvancedGameOffense", "AdvancedGameDefense", {}),
        (havoc, "havoc", "havoc_coverage", "GameHavocUnit", "GameHavocUnit", {"conference": True, "both": True}),
        (ppa, "ppa", "ppa_coverage", "TeamGamePPAUnit", "TeamGamePPAUnit", {"conference": True}),
    ):
        if other is None:
            out = out.withColumns(_none(coverage, **{f"{prefix}_offense": offense, f"{prefix}_defense": defense}))
        else:
            out = with_units(out, other, prefix, coverage, requested_team, **checked)
    return out.select(
        *_GAME, *_SIDE, "team_stats_coverage", "team_stats", "advanced_box_coverage", "advanced_box",
        *[c for p, v in (("advanced", "advanced_stats"), ("havoc", "havoc"), ("ppa", "ppa")) for c in (f"{v}_coverage", f"{p}_offense", f"{p}_defense")],
    )
