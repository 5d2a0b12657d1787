import datetime as dt
import json

import pytest

from fieldloom.errors import IdentityAmbiguous, IdentityNotFound, RequestError
from fieldloom.products import identities
from fieldloom.sources import registry, rows
from fieldloom.sources.responses import Responses
from fieldloom.sources.transport import Answer
from tests.test_season_products import AT, of
from tests.test_sources import NOW, sample


@pytest.fixture(scope="module")
def known(spark):
    team = lambda i, n, *a: {"id": i, "school": n, "abbreviation": n[:2].upper(), "alternate_names": list(a)}
    teams = of(spark, "Team", team(1, "Alpha", "The A", "Both"), team(2, "Beta", "Both"), team(0, "None"), team(3, " "))
    games = [{"id": k, "season": 2024, "week": k % 2, "home_id": 1 + k % 2, "away_id": 9, "start_date": AT - dt.timedelta(days=k), "completed": True} for k in (4, 5, 6)]
    player = lambda i, team, **k: {"id": i, "team": team, "first_name": "Ann", "last_name": "Lee", "position": "QB"} | k
    roster = of(spark, "RosterPlayer", player("a", "Alpha"), player("a", "Beta", position=None), player("b", "Beta", first_name="Bo"), player("c", "Gamma", first_name="Bo"))
    frames = {
        "teams": identities.project("teams", teams), "games": identities.project("games", of(spark, "Game", *games)),
        "conferences": identities.project("conferences", of(spark, "Conference", {"id": 4, "name": "Big Lake", "short_name": "Lake", "abbreviation": "BL"})),
        "venues": identities.project("venues", of(spark, "Venue", {"id": 5, "name": "Ｆｉｅｌｄ"})),
        "athletes": identities.project("athletes", roster).distinct(), "athlete_team_seasons": identities.project("athlete_team_seasons", roster, season=2024),
    }
    return identities.Identities(frames)


def test_resolving(known):
    assert known.facts["teams"].count() == 3
    assert known.team("alpha").id == known.team(" THE  a").id == known.team("1").id == known.team("AL").id == 1
    assert known.conference("lake").id == 4 and known.conference("bl").id == 4 and known.venue("field").id == 5 and known.game(4).status == "completed"
    for call in (lambda: known.team("both"), lambda: known.athlete("Bo Lee")):
        with pytest.raises(IdentityAmbiguous):
            call()
    for call in (lambda: known.team("nobody"), lambda: known.venue("no"), lambda: known.game(99), lambda: known.athlete("Ann Lee", team="Gamma")):
        with pytest.raises(IdentityNotFound):
            call()
    assert [r.id for r in known.games(2024).collect()] == [6, 5, 4] and [r.id for r in known.games(2024, week=1, team="Beta").collect()] == [5]
    a = known.athlete("ann LEE")
    assert (a.id, a.team, a.season, a.position) == ("a", None, 2024, "QB")
    assert known.athlete("Ann Lee", team="beta").team == "Beta" and known.athlete("Bo Lee", team="gamma").id == "c"


def test_facts_of_all_types(spark):
    for name, f in identities.FACTS.items():
        e = registry.endpoints()[f.method]
        got = identities.project(name, of(spark, e.model, {}), season=2024)
        assert got.columns == [*f.keys, *f.fields] and got.count() == 1
    teams = [identities.project("teams", of(spark, "Team", {"id": 1, "school": n, "conference": c})) for n, c in (("Old", "C"), ("New", None))]
    seen = [identities.observed(t, "teams", authority=k, source=s, at=AT) for t, k, s in ((teams[0], 2, "a"), (teams[1], 1, "b"))]
    row = identities.merged("teams", *seen).first()
    assert (row.school, row.conference) == ("Old", "C")


def test_hydration(spark, tmp_path):
    assert len(identities.hydration([2023, 2024, 2024])) == 8 and len(identities.hydration([2024], vocabularies=True)) == 9
    with pytest.raises(RequestError):
        identities.hydration([24])
    models = {e.path: e for e in registry.endpoints().values()}
    sent = []

    def send(path, parameters, headers):
        sent.append(path)
        return Answer(200, json.dumps([sample(rows.model(models[path].model))]).encode())

    r = Responses(spark, f"file://{tmp_path}/r", send, clock=lambda: NOW)
    assert len(identities.hydrate(r, [2024], now=NOW, dry_run=True)) == 6 and not sent
    assert len(identities.hydrate(r, [2024], now=NOW)) == 6 and len(sent) == 6
    assert identities.hydrate(r, [2024], now=NOW) == [] and len(identities.pending(r, identities.hydration([2024]), NOW + dt.timedelta(days=8))) == 1
