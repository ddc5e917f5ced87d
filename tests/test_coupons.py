"""Composer, fallback and variants on bounded pools against plain search over the whole day."""
import itertools

import numpy as np
import pytest

from touchline.operators import compose as co

FAMS = ["1X2", "over_under", "btts", "double_chance"]


def day_rows(days=4, matches=60, seed=0, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for m in range(matches * (6 if d == hot else 1)):
            for o in range(int(rng.integers(1, 5))):
                fam = FAMS[int(rng.integers(0, 4))]
                rows.append((f"2000-01-{d + 1:02d}", d * 10000 + m, f"{fam}_{o}" if fam == "over_under" else fam, f"s{o}", o, fam,
                             round(float(rng.uniform(0.55, 0.95)), 3), round(float(rng.uniform(1.05, 1.6)), 2), bool(rng.uniform() < 0.3),
                             round(float(rng.uniform(0.3, 0.9)), 4)))
    return rows


SCHEMA = "day string, match_id long, market string, selection string, ord int, base string, prob double, odds double, synthetic boolean, composite double"


def dicts(rows):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]


def order(rows):
    return sorted(rows, key=lambda p: (-p["composite"], p["match_id"], p["ord"]))


def plain_compose(rows, num_legs, max_coupons, floor):
    """The rule written down directly over every pick of the day."""
    taken, out = set(), []
    for size in range(num_legs, 0, -1):
        while len(out) < max_coupons:
            pool = [p for p in order(rows) if p["match_id"] not in taken]
            legs = []
            for p in pool:
                if len(legs) < size and p["match_id"] not in {x["match_id"] for x in legs} and p["base"] not in {x["base"] for x in legs}:
                    legs.append(p)
            if len(legs) < size:
                break
            for _ in range(size):
                if np.prod([x["odds"] for x in legs]) >= floor:
                    break
                weak = min(range(size), key=lambda i: legs[i]["odds"])
                others = [x for i, x in enumerate(legs) if i != weak]
                new = next((p for p in pool if p["match_id"] not in {x["match_id"] for x in legs}
                            and p["base"] not in {x["base"] for x in others} and p["odds"] > legs[weak]["odds"]), None)
                if new is None:
                    break
                legs[weak] = new
            if np.prod([x["odds"] for x in legs]) < floor:
                break
            out.append([(x["match_id"], x["market"], x["selection"]) for x in legs])
            taken |= {x["match_id"] for x in legs}
    return out


@pytest.mark.parametrize("floor,legs", [(1.6, 2), (3.0, 3), (2.4, 2)])
def test_composer_equals_whole_day_search(spark, floor, legs):
    rows = day_rows()
    got = co.compose(spark.createDataFrame(rows, SCHEMA), num_legs=legs, max_coupons=4, min_odds=floor).toPandas()
    for day in sorted({r[0] for r in rows}):
        want = plain_compose([p for p in dicts(rows) if p["day"] == day], legs, 4, floor)
        g = got[got.day == day].sort_values(["coupon_no", "leg_no"])
        have = [[(x.match_id, x.market, x.selection) for x in c.itertuples()] for _, c in g.groupby("coupon_no")]
        assert have == want
        assert g.match_id.is_unique
    assert (got[got.coupon_no == 1].kind == "primary").all()


def test_fallback_equals_whole_day_search(spark):
    rows = day_rows(seed=7)
    got = co.fallback(spark.createDataFrame(rows, SCHEMA), num_legs=3, min_odds=3.2).toPandas()
    for day in sorted({r[0] for r in rows}):
        best = {}
        for p in order([p for p in dicts(rows) if p["day"] == day]):
            best.setdefault(p["match_id"], p)
        ranked = sorted(best.values(), key=lambda p: (p["synthetic"], -p["composite"], p["match_id"]))
        legs = ranked[:3]
        for c in sorted(best.values(), key=lambda p: (-p["odds"], p["synthetic"], -p["composite"], p["match_id"])):
            if np.prod([x["odds"] for x in legs]) >= 3.2:
                break
            weak = min(range(3), key=lambda i: legs[i]["odds"])
            if c["match_id"] not in {x["match_id"] for x in legs} and c["odds"] > legs[weak]["odds"]:
                legs[weak] = c
        want = [x["match_id"] for x in legs] if np.prod([x["odds"] for x in legs]) >= 3.2 else []
        assert got[got.day == day].sort_values("leg_no").match_id.tolist() == want


def test_suggest_falls_back_only_on_empty_days(spark):
    df = spark.createDataFrame(day_rows(), SCHEMA)
    strict = df.filter("day <> '2000-01-03'")
    got = co.suggest(strict, df, num_legs=2, min_odds=1.6).toPandas()
    assert set(got[got.kind == "fallback"].day) <= {"2000-01-03"}
    assert set(got[got.kind != "fallback"].day) == {"2000-01-01", "2000-01-02", "2000-01-04"}


def test_variants_three_legs(spark):
    rows = day_rows(days=2, matches=20, seed=11)
    got = co.hit_variants(spark.createDataFrame(rows, SCHEMA), num_legs=3, first=4).collect()
    for day in ("2000-01-01", "2000-01-02"):
        best = {}
        for p in order([p for p in dicts(rows) if p["day"] == day]):
            best.setdefault(p["match_id"], p)
        pool, taken = sorted(best.values(), key=lambda p: (-p["prob"], p["match_id"])), set()
        for key, least, lo, hi in co.VARIANTS:
            free = [p for p in pool if p["match_id"] not in taken]
            ok = [c for c in itertools.combinations(free, 3) if len({x["base"] for x in c}) == 3
                  and lo <= np.prod([x["odds"] for x in c]) <= hi and np.prod([x["prob"] for x in c]) >= least]
            row = [r for r in got if r.day == day and r.variant == key]
            if not ok:
                assert not row
                continue
            top = max(ok, key=lambda c: round(float(np.prod([x["prob"] for x in c])), 12))
            assert row[0].ids == [x["match_id"] for x in top]
            taken |= {x["match_id"] for x in top}
