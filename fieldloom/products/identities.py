"""Identities: canonical facts projected from responses, what a catalog of them covers, and who is meant by a name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.errors import IdentityAmbiguous, IdentityNotFound, RequestError
from fieldloom.functions.text import catalog_text
from fieldloom.operators.state import merge_observations
from fieldloom.sources import registry
from fieldloom.sources.responses import Responses, request_key

MODES = ("ensure_fresh", "allow_stale", "local_only")
#: Candidates that an ambiguity names, at most.
NAMED = 10


@dataclass(frozen=True)
class Fact:
    """What a fact type takes from a method's rows: keys and fields are (name, SQL over the row); :season is the request's."""

    method: str
    keys: Mapping[str, str]
    fields: Mapping[str, str]
    explode: str = ""


#: Facts by type. A key must be there: whole numbers above zero, texts that aren't blank.
FACTS = {
    "teams": Fact("teams.list", {"id": "id"}, {"school": "school", "abbreviation": "abbreviation", "alternate_names": "alternate_names", "conference": "conference", "classification": "classification", "venue_id": "location.id"}),
    "team_seasons": Fact("teams.list", {"team_id": "id", "season": ":season"}, {"conference": "conference", "classification": "classification"}),
    "conferences": Fact("conferences.list", {"id": "id"}, {"name": "name", "short_name": "short_name", "abbreviation": "abbreviation", "classification": "classification"}),
    "affiliations": Fact("conferences.affiliations", {"team_id": "team_id", "conference_id": "conference_id", "start_year": "start_year"}, {"end_year": "end_year"}),
    "venues": Fact("venues.list", {"id": "id"}, {"name": "name", "city": "city", "state": "state"}),
    "games": Fact(
        "games.list", {"id": "id"},
        {"season": "season", "week": "week", "season_type": "season_type", "start_date": "start_date", "status": "if(completed, 'completed', null)", "home_id": "home_id", "away_id": "away_id", "venue_id": "venue_id"},
    ),
    "athletes": Fact("teams.roster", {"id": "id"}, {"name": "concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))"}),
    "athlete_team_seasons": Fact("teams.roster", {"athlete_id": "id", "team_name": "team", "season": ":season"}, {"position": "position"}),
    "recruits": Fact("recruiting.players", {"id": "id"}, {"athlete_id": "athlete_id", "name": "name", "year": "year"}),
    "coaches": Fact("coaches.tenures", {"id": "coach.id"}, {"name": "concat_ws(' ', nullif(coach.first_name, ''), nullif(coach.last_name, ''))"}),
    "coach_team_seasons": Fact("coaches.tenures", {"coach_id": "coach.id", "team_id": "team.id", "start_year": "start_year"}, {"end_year": "end_year"}),
    "drives": Fact("drives.list", {"id": "id"}, {"game_id": "game_id"}),
    "plays": Fact("plays.list", {"id": "id"}, {"drive_id": "drive_id", "game_id": "game_id"}),
    "vocabularies": Fact("plays.types", {"namespace": "'play_type'", "id": "cast(id as string)"}, {"name": "text"}),
    "playoff_matchups": Fact("playoffs.games", {"id": "id"}, {"bracket_slot": "bracket_slot", "season": ":season", "linked_game_id": "game.id"}),
}
#: What a response to a method proves about identities; (namespace, capabilities).
CAPABILITIES = {
    "teams.list": ("team", ("team.core_identity", "team.aliases")),
    "teams.fbs": ("team", ("team.core_identity",)),
    "venues.list": ("venue", ("venue.identity",)),
    "conferences.list": ("conference", ("conference.identity",)),
    "conferences.affiliations": ("team", ("team.conference_history",)),
    "games.list": ("game", ("game.identity", "game.schedule", "game.team_relationships")),
    "teams.roster": ("athlete", ("athlete.identity", "athlete.team_season", "recruit.link")),
}


def project(fact: str, rows: DataFrame, *, season: int | None = None) -> DataFrame:
    """The facts of a type that a method's rows hold: keys, then fields; blank texts are null, rows without a whole key are left out."""
    f = FACTS[fact]

    def value(sql: str) -> Column:
        return F.lit(season).cast("long") if sql == ":season" else F.expr(sql)

    out = rows.select(*[value(s).alias(n) for n, s in {**f.keys, **f.fields}.items()])
    clean = {n: F.when(F.trim(n) != "", F.col(n)) for n, kind in out.dtypes if kind == "string"}
    out = out.withColumns(clean) if clean else out
    for k in f.keys:
        out = out.where(F.col(k) > 0 if dict(out.dtypes)[k] == "bigint" else F.col(k).isNotNull())
    return out


def observed(facts: DataFrame, fact: str, *, authority: int, source: str, at: dt.datetime) -> DataFrame:
    """Facts as observations: every field with its state, so that a null that was seen differs from one that wasn't."""
    fields = FACTS[fact].fields
    states = [F.struct(F.when(F.col(n).isNull(), "null").otherwise("value").alias("state"), F.col(n).alias("value")).alias(n) for n in fields]
    return facts.select(*FACTS[fact].keys, *states, F.lit(authority).alias("authority"), F.lit(source).alias("source"), F.lit(at).alias("observed_at"))


def merged(fact: str, *observations: DataFrame) -> DataFrame:
    """One row a key: each field of the highest (authority, time, source) that saw it."""
    all_ = observations[0]
    for o in observations[1:]:
        all_ = all_.unionByName(o)
    return merge_observations(all_, list(FACTS[fact].keys), list(FACTS[fact].fields), authority="authority", observed_at="observed_at", source="source")


def coverage(n_rows: Column, cap: Column) -> Column:
    """'complete', or 'possibly_truncated' where a response has as many rows as its endpoint ever gives."""
    return F.when(cap.isNotNull() & (n_rows >= cap), "possibly_truncated").otherwise("complete")


def hydration(seasons: Sequence[int], *, classification: str | None = None, vocabularies: bool = False) -> list[tuple[str, dict]]:
    """The requests that a catalog of the seasons needs: four of them and two a season, and three vocabularies where asked for."""
    if any(isinstance(s, bool) or not isinstance(s, int) or s < 1869 for s in seasons):
        raise RequestError("seasons are years from 1869 on")
    scope = {} if classification is None else {"classification": classification}
    calls = [("teams.list", {}), ("conferences.list", {}), ("venues.list", {}), ("conferences.affiliations", dict(scope))]
    for s in sorted(set(seasons)):
        calls += [("games.list", {"year": s, **scope}), ("teams.roster", {"year": s, **scope})]
    if vocabularies:
        calls += [("plays.types", {}), ("plays.stat_types", {}), ("stats.categories", {})]
    return [(m, registry.request(m, **p)) for m, p in calls]


def pending(responses: Responses, calls: Sequence[tuple[str, dict]], now: dt.datetime) -> list[tuple[str, dict]]:
    """The calls without a fresh response: what hydrating would fetch."""
    fresh = {r.key for r in responses.records().where(F.col("fresh_until") > F.lit(now)).select("key").collect()}  # as many as requests
    path = lambda m: registry.endpoints()[m].path
    return [(m, p) for m, p in calls if request_key(path(m), p) not in fresh]


def hydrate(responses: Responses, seasons: Sequence[int], *, now: dt.datetime, dry_run: bool = False, **options) -> list[tuple[str, dict]]:
    """Fetch what the catalog of the seasons lacks; returns it. Fresh responses are left alone."""
    todo = pending(responses, hydration(seasons, **options), now)
    for m, p in [] if dry_run else todo:
        e = registry.endpoints()[m]
        responses.locate(e.path, p, e.schema, shape=e.shape, now=now)
    return todo


class Identities:
    """Who a name, or an id written as text, stands for, in projected facts by type. Absent and ambiguous names raise."""

    def __init__(self, facts: Mapping[str, DataFrame]):
        self.facts = facts

    def _one(self, what: str, found: DataFrame):
        rows = found.limit(NAMED + 1).collect()
        if not rows:
            raise IdentityNotFound(what)
        if len(rows) > 1:
            raise IdentityAmbiguous(f"{what}: {[r.id for r in rows[:NAMED]]}")
        return rows[0]

    def _named(self, fact: str, text: str, columns: Sequence[str], aliases: str = ""):
        """By id where the text is one, else by any of the names, compatibly normalised and folded."""
        df = self.facts[fact]
        if text.strip().isdigit():
            row = df.where(F.col("id") == int(text)).take(1)
            if row:
                return row[0]
        names = F.array(*[F.col(c) for c in columns])
        names = F.concat(names, F.coalesce(F.col(aliases), F.array().cast("array<string>"))) if aliases else names
        each = df.select("id", F.explode(names).alias("_n")).where("_n is not null")
        want = " ".join(text.split())
        ids = each.where(catalog_text(F.col("_n")) == catalog_text(F.lit(want))).select("id").distinct()
        return self._one(text, df.join(ids, "id", "left_semi").orderBy("id"))

    def team(self, text: str):
        return self._named("teams", text, ["school", "abbreviation"], "alternate_names")

    def conference(self, text: str):
        return self._named("conferences", text, ["name", "short_name", "abbreviation"])

    def venue(self, text: str):
        return self._named("venues", text, ["name"])

    def game(self, game_id: int):
        return self._one(str(game_id), self.facts["games"].where(F.col("id") == game_id))

    def games(self, season: int, week: int | None = None, team: str | None = None) -> DataFrame:
        """The games of a season, of a week and with a team where they are given, by start and id."""
        g = self.facts["games"].where(F.col("season") == season)
        g = g if week is None else g.where(F.col("week") == week)
        if team is not None:
            of = self.team(team).id
            g = g.where((F.col("home_id") == of) | (F.col("away_id") == of))
        return g.orderBy("start_date", "id")

    def athlete(self, name: str, team: str | None = None, season: int | None = None):
        """One athlete; team and season only where the memberships leave no choice, the position likewise or the first one's."""
        a = self.facts["athletes"].where(catalog_text(F.col("name")) == catalog_text(F.lit(" ".join(name.split()))))
        m = self.facts["athlete_team_seasons"]
        m = m if team is None else m.where(catalog_text(F.col("team_name")) == catalog_text(F.lit(" ".join(team.split()))))
        m = m if season is None else m.where(F.col("season") == season)
        j = a.join(m.withColumnRenamed("athlete_id", "id"), "id", "left" if team is None and season is None else "inner")
        only = lambda c: F.when(F.count_distinct(c) == 1, F.min(c))
        first = F.min_by("position", F.struct("season", "team_name"))
        return self._one(name, j.groupBy("id", "name").agg(F.coalesce(only("position"), first).alias("position"), only("team_name").alias("team"), only("season").alias("season")).orderBy("id"))
