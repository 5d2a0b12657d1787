"""How long a response stays fresh and is kept: profiles by path, refined by what the response holds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Ttl:
    fresh_for: dt.timedelta
    retain_for: dt.timedelta


def _ttl(fresh: dt.timedelta, retain: dt.timedelta) -> Ttl:
    return Ttl(fresh, retain)


_d, _h, _m, _s = (lambda n: dt.timedelta(days=n)), (lambda n: dt.timedelta(hours=n)), (lambda n: dt.timedelta(minutes=n)), (lambda n: dt.timedelta(seconds=n))
#: Fresh for, kept for.
PROFILES = {
    "stable_reference": _ttl(_d(180), _d(730)),
    "reference_vocabulary": _ttl(_d(365), _d(1825)),
    "roster": _ttl(_d(7), _d(30)),
    "schedule": _ttl(_d(3), _d(14)),
    "active_season": _ttl(_d(1), _d(14)),
    "recruiting": _ttl(_d(3), _d(30)),
    "historical": _ttl(_d(365), _d(1825)),
    "betting": _ttl(_m(15), _h(6)),
    "weather": _ttl(_h(1), _h(12)),
    "live_scoreboard": _ttl(_s(15), _m(2)),
    "live_plays": _ttl(_s(5), _s(30)),
}
#: The profile of a path; "operational" is never kept, other paths are of the active season.
PATHS = {
    "operational": ("/info", "/info/usage"),
    "stable_reference": ("/teams", "/teams/fbs", "/venues", "/conferences", "/conferences/affiliations"),
    "reference_vocabulary": ("/plays/types", "/plays/stats/types", "/stats/categories", "/draft/teams", "/draft/positions"),
    "roster": ("/roster",),
    "schedule": ("/games", "/calendar", "/games/media"),
    "live_scoreboard": ("/scoreboard",),
    "live_plays": ("/live/plays",),
    "weather": ("/games/weather",),
    "betting": ("/lines",),
    "recruiting": ("/recruiting/players", "/recruiting/teams", "/recruiting/groups", "/player/portal"),
}
#: A game is near, or still corrected, for so long around its start.
NEAR, CORRECTED = dt.timedelta(hours=48), dt.timedelta(hours=72)


def profile(path: str) -> str:
    return next((name for name, paths in PATHS.items() if path in paths), "active_season")


def season_closed(year: int, now: dt.datetime) -> bool:
    """An earlier season is over; the last one is from March on."""
    return year < now.year - 1 or (year == now.year - 1 and (now.month, now.day) >= (3, 1))


def season_closed_column(year: Column, now: Column) -> Column:
    return (year < F.year(now) - 1) | ((year == F.year(now) - 1) & (F.month(now) >= 3))


def game_facts(games: DataFrame, now: dt.datetime) -> DataFrame:
    """One row about a page of games: n_rows, all_closed, near (open and close to its start), corrected (done, but lately)."""
    at = F.lit(now)
    gap = F.unix_micros("start_date") - F.unix_micros(at)
    micros = lambda t: int(t.total_seconds() * 1e6)
    late = -gap <= micros(CORRECTED)
    return games.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.every(F.col("completed") & ~late), F.lit(False)).alias("all_closed"),
        F.coalesce(F.some(~F.col("completed") & (F.abs(gap) <= micros(NEAR))), F.lit(False)).alias("near"),
        F.coalesce(F.some(F.col("completed") & late), F.lit(False)).alias("corrected"),
    )


def ttl(path: str, parameters: Mapping, n_rows: int, now: dt.datetime, *, all_closed: bool = False, near: bool = False, corrected: bool = False, overrides: Mapping[str, Ttl] | None = None) -> Ttl | None:
    """The shortest of the path's profile and its refinements; None for what is never kept.

    Closed games, and empty pages of a closed season, are historical; an empty page of a season to come stays fresh a day
    at most. Games near their start or lately over stay fresh a day.
    """
    name = profile(path)
    if name == "operational":
        return None
    known = PROFILES | dict(overrides or {})
    base = known["historical"] if path == "/games" and n_rows and all_closed else known[name]
    year = parameters.get("year")
    if not n_rows and isinstance(year, int):
        if season_closed(year, now):
            base = known["historical"]
        elif year >= now.year:
            base = Ttl(min(base.fresh_for, _d(1)), base.retain_for)
    found = [base]
    if path == "/games":
        found += [Ttl(_h(24), _d(7))] * near + [Ttl(_h(24), _d(30))] * corrected
    return min(found)


def refined_seconds(*choices: Column) -> Column:
    """The least of several lifetimes in seconds, nulls left out: what a table of lifetimes is refined by."""
    return F.least(*choices).cast("long")


def state(fresh_until: Column, retained_until: Column, now: Column) -> Column:
    """'fresh', 'stale' (kept beyond its freshness) or 'expired'; null times have expired."""
    return F.when(fresh_until > now, "fresh").when(retained_until > now, "stale").otherwise("expired")
