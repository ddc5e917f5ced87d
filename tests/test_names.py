"""Blocked name matching finds exactly what a search over all pairs finds."""
import difflib
import random

import pytest

from touchline.functions import naming
from touchline.operators import resolve as rs
from touchline.plans import derive as D
from touchline.session import literal_rows


def spellings(seed):
    rnd = random.Random(seed)
    out = set()
    for club in D.CLUBS + ["TPS", "SJK", "AB", "Kuopion Palloseura", "Seinäjoen Jalkapallokerho"]:
        for _ in range(8):
            s = list(club)
            for _ in range(rnd.randint(1, 4)):
                i = rnd.randrange(len(s))
                rnd.choice([lambda: s.__setitem__(i, rnd.choice("aeiorst")), lambda: s.insert(i, rnd.choice("aeiorst ")), lambda: len(s) > 2 and s.pop(i)])()
            out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("cutoff,loose", [(0.88, False), (0.86, False), (0.72, False), (0.72, True)])
def test_ladder_equals_all_pairs(spark, cutoff, loose):
    names = [(f"L{i % 2}", s) for i, s in enumerate(spellings(1))]
    clubs = [(l * 100 + i, c, f"L{l}") for l in range(2) for i, c in enumerate(D.CLUBS + ["TPS Turku", "SJK"])]
    nd = spark.createDataFrame(names, "league string, name string")
    td = spark.createDataFrame(clubs, "team_id long, name string, league string")
    al = literal_rows(spark, list(D.ALIASES.items()), "alias, name")
    got = {(r.league, r.name): (r.team_id, r.method) for r in rs.resolve(nd, td, al, cutoff=cutoff, containment=loose).collect()}
    norm = {r.name: r.k for r in nd.select("name", naming.feed_name(nd["name"]).alias("k")).collect()}
    keys = {}
    for r in td.select("league", "team_id", naming.feed_name(td["name"]).alias("k")).collect():
        keys.setdefault(r.league, {})[r.k] = min(r.team_id, keys.get(r.league, {}).get(r.k, 10**9))
    want = {}
    for lg, s in names:
        n = norm[s]
        if n in keys[lg]:
            want[(lg, s)] = (keys[lg][n], "exact")
            continue
        if not n:
            continue
        if loose and len(n) >= 3:
            inside = [t for k, t in keys[lg].items() if len(k) >= 3 and (k in n or n in k)]
            if inside:
                want[(lg, s)] = (min(inside), "contains")
                continue
        scored = [(difflib.SequenceMatcher(None, k, n).ratio(), k) for k in keys[lg]]
        best = max((x for x in scored if x[0] >= cutoff), default=None)
        if best:
            want[(lg, s)] = (keys[lg][best[1]], "fuzzy")
    assert got == want
    assert any(m == "fuzzy" for _, m in got.values())


def test_ladder_reads_its_names_once(spark, tmp_path):
    """Containment and similarity start from stored spellings and keys: the tables behind them are not computed again in each step."""
    spark.createDataFrame([("L0", s) for s in spellings(2)], "league string, name string").write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([(i, c, "L0") for i, c in enumerate(D.CLUBS)], "team_id long, name string, league string").write.parquet(f"{tmp_path}/clubs")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    out = rs.resolve(read("names"), read("clubs"), literal_rows(spark, list(D.ALIASES.items()), "alias, name"), cutoff=0.72, containment=True)
    files = [f.rsplit("/", 2)[-2] for f in out.inputFiles()]
    assert files and not {"names", "clubs"} & set(files)
    assert out.count() == out.select("name").distinct().count() > 0
