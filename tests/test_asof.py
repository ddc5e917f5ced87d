"""As-of features against a direct reading of the rule: ties, one hot team, half the rows on one day."""
import datetime as dt
import random

import pytest

from touchline.operators import features as ft
from touchline.operators import timeline as tl

SCHEMA = ("match_id long, league string, season string, kickoff timestamp_ntz, home_team_id long, away_team_id long, status string, ft_home int, ft_away int")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = []
    for i in range(220):
        h = 1 if i % 3 == 0 else rnd.randint(1, 6)
        a = rnd.choice([t for t in range(1, 7) if t != h])
        day = 5 if i % 2 else rnd.randint(0, 30)
        t = dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=rnd.choice([12, 15, 18]))
        done = rnd.random() < 0.85
        out.append((i, "E0", "1920", t, h, a, "finished" if done else "scheduled", rnd.randint(0, 4) if done else None, rnd.randint(0, 3) if done else None))
    return out


def past(rows, team, t):
    mine = [r for r in rows if team in (r[4], r[5]) and r[3] < t and r[6] == "finished"]
    return [(r[3], r[0], r[7] if r[4] == team else r[8], r[8] if r[4] == team else r[7]) for r in sorted(mine, key=lambda r: (r[3], r[0]))]


def test_record_and_form(spark, rows):
    m = spark.createDataFrame(rows, SCHEMA)
    rec = {(r.team_id, r.kickoff): r for r in ft.record_before(m).collect()}
    form = {(r.team_id, r.kickoff): r for r in ft.form_before(m).collect()}
    for (team, t), r in rec.items():
        p = past(rows, team, t)
        assert (r.played, r.gf, r.ga) == (len(p), sum(x[2] for x in p), sum(x[3] for x in p))
        assert r.wins == sum(x[2] > x[3] for x in p)
        if not p:
            assert (team, t) not in form
            continue
        last, f = p[-6:], form[(team, t)]
        assert (f.games, f.wins) == (len(last), sum(x[2] > x[3] for x in last))
        assert f.gf_per_game == pytest.approx(sum(x[2] for x in last) / len(last)) and f.season_games == len(p)


def test_table_rank(spark, rows):
    m = spark.createDataFrame(rows, SCHEMA)
    t = ft.table_before(m).collect()
    for k in {r.kickoff for r in t}:
        table = []
        for team in range(1, 7):
            p = past(rows, team, k)
            pts = sum(3 if x[2] > x[3] else 1 if x[2] == x[3] else 0 for x in p)
            table.append((-pts, -sum(x[2] - x[3] for x in p), -sum(x[2] for x in p), team))
        assert [r.team_id for r in sorted((r for r in t if r.kickoff == k), key=lambda r: r.rnk)] == [x[3] for x in sorted(table)]


def test_row_index_is_the_sorted_position(spark, rows):
    m = spark.createDataFrame(rows, SCHEMA)
    got = {r.match_id: r.idx for r in tl.with_row_index(m, "kickoff", "match_id").collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))}
    assert got == want
