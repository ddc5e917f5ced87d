"""Candidate and pick enumeration: probabilities, prices, signals, composite score, reasons."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import naming, settle, value
from touchline.operators import calibrate
from touchline.operators import markets as mk
from touchline.operators import odds as od

# Score weights, edge floor, verified league strategies (families, edge, probability).
WEIGHTS = {"prob": 0.15, "value": 0.45, "motivation": 0.20, "form": 0.10, "availability": 0.10}
MIN_VALUE_EDGE = 0.03
LEAGUE_POLICY = {
    "E0": (["over_under"], 0.03, 0.55),
    "D1": (["over_under"], 0.03, 0.60),
    "I1": (["1X2"], 0.01, 0.50),
}
KEY_POSITIONS = ("goalkeeper", "forward", "attacker")
SIGNAL_COLUMNS = [f"{s}_{c}" for s in "ha" for c in
                  ("relegation_risk", "title_push", "europe_push", "dead_rubber", "intensity", "form_delta", "absent", "key_name")]


def candidates(matches: DataFrame, best: DataFrame) -> DataFrame:
    """Played selections with a price above 1.01, their de-vigged edge and outcome.

    A double chance uses its own margin when fully priced, else two thirds of the 1X2 margin.
    """
    wanted = [m for m in mk.ENUMERATED if m != "odd_even"]
    m = matches.select("match_id", "league", "kickoff", "ft_home", "ft_away", "lam", "mu", "rho")
    x = od.priced(mk.long_book(od.with_prices(m, best, wanted, borrow=True), wanted)).filter("odds > 1.01")
    e = value.fair_edge(F.col("prob"), F.lit(1.0) / F.col("odds"), F.col("overround"))
    h = settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away"))
    return x.select("match_id", "league", "kickoff", "market", "selection", "prob", "odds", e.alias("edge"), h.alias("hit")) \
        .filter("hit IS NOT NULL")


def motivation_score() -> str:
    """SQL text over market, selection, h_*/a_* signals."""
    h = "greatest(h_relegation_risk, h_title_push, h_europe_push)"
    a = "greatest(a_relegation_risk, a_title_push, a_europe_push)"
    return f"""CASE
      WHEN market IN ('1X2', 'double_chance') AND selection IN ('1', '1X') THEN least(1D, {h} + 0.5D * a_dead_rubber)
      WHEN market IN ('1X2', 'double_chance') AND selection IN ('2', 'X2') THEN least(1D, {a} + 0.5D * h_dead_rubber)
      WHEN (market LIKE 'over_under%' OR market = 'btts') AND selection IN ('over', 'yes') THEN
        CASE WHEN (h_intensity + a_intensity) / 2 >= 0.5D THEN (h_intensity + a_intensity) / 2
             WHEN (h_dead_rubber + a_dead_rubber) / 2 >= 0.4D THEN -(h_dead_rubber + a_dead_rubber) / 2 ELSE 0D END
      WHEN (market LIKE 'over_under%' OR market = 'btts') AND selection IN ('under', 'no') THEN
        IF((h_dead_rubber + a_dead_rubber) / 2 >= 0.4D, (h_dead_rubber + a_dead_rubber) / 2, 0D)
      ELSE 0D END"""


def form_score() -> str:
    clamp = lambda e: f"greatest(-1D, least(1D, {e}))"
    hd, ad = "h_form_delta", "a_form_delta"
    return f"""CASE
      WHEN market = '1X2' AND selection = '1' THEN {clamp(f'{hd} - {ad}')}
      WHEN market = '1X2' AND selection = '2' THEN {clamp(f'{ad} - {hd}')}
      WHEN market = '1X2' THEN -greatest(abs({hd}), abs({ad}))
      WHEN market = 'double_chance' AND selection = '1X' THEN {clamp(f'{hd} - 0.5D * {ad}')}
      WHEN market = 'double_chance' AND selection = 'X2' THEN {clamp(f'{ad} - 0.5D * {hd}')}
      WHEN market = 'double_chance' AND selection = '12' THEN {clamp(f'0.5D * (abs({hd}) + abs({ad}))')}
      WHEN market = 'btts' OR market LIKE 'over_under%' THEN
        {clamp(f"IF(selection IN ('yes', 'over'), 1D, -1D) * 0.5D * ({hd} + {ad})")}
      ELSE 0D END"""


def availability_score() -> str:
    diff = "(greatest(-3, least(3, a_absent - h_absent)) / 3D)"
    heavy = "greatest(h_absent, a_absent) >= 3"
    return f"""CASE
      WHEN market = '1X2' AND selection = '1' THEN {diff}
      WHEN market = '1X2' AND selection = '2' THEN -{diff}
      WHEN market = '1X2' THEN -abs({diff}) * 0.5D
      WHEN market = 'double_chance' AND selection = '1X' THEN {diff} * 0.7D
      WHEN market = 'double_chance' AND selection = 'X2' THEN -{diff} * 0.7D
      WHEN market = 'double_chance' AND selection = '12' THEN least(1D, abs({diff}) * 0.5D)
      WHEN market = 'btts' OR market LIKE 'over_under%' THEN
        IF({heavy}, IF(selection IN ('yes', 'over'), -0.5D, 0.5D), 0D)
      ELSE 0D END"""


def composite(prob="prob", edge="edge", mot="motivation_score", form="form_score", avail="availability_score") -> str:
    w = WEIGHTS
    return (f"{w['prob']}D * {prob} + {w['value']}D * (0.5D + 0.5D * (greatest(-0.3D, least(0.3D, {edge})) / 0.3D))"
            f" + {w['motivation']}D * (0.5D + 0.5D * {mot}) + {w['form']}D * (0.5D + 0.5D * {form})"
            f" + {w['availability']}D * (0.5D + 0.5D * {avail})")


def _top_stake(p: str, side: str) -> str:
    r, t, e = f"{p}_relegation_risk", f"{p}_title_push", f"{p}_europe_push"
    best = f"greatest({r}, {t}, {e})"
    word = (f"CASE WHEN {r} = {best} THEN 'küme düşme hattına yakın' WHEN {t} = {best} THEN 'şampiyonluk yarışında'"
            f" ELSE 'Avrupa kupası hattında' END")
    return f"IF({best} >= 0.5D, format_string('%s ({side}) %s (%.0f%%)', {p}_team, {word}, {best} * 100), NULL)"


def reasons() -> str:
    """SQL text: the user-facing reasons of a pick, in display order."""
    h = "greatest(h_relegation_risk, h_title_push, h_europe_push)"
    a = "greatest(a_relegation_risk, a_title_push, a_europe_push)"
    goals = "(market LIKE 'over_under%' OR market = 'btts')"
    return f"""array_compact(array(
      format_string('Model olasılığı %%%.0f', prob * 100),
      CASE WHEN synthetic THEN format_string('Piyasa oranı bulunamadı — model olasılığından tahmini oran %.2f kullanıldı', odds)
           WHEN edge > 0.03D THEN format_string('Piyasa oranı %.2f (impl %%%.0f) — model %%%.0f edge görüyor', odds, 100D / odds, edge * 100)
           WHEN edge < -0.05D THEN format_string('Piyasa bu seçimde daha iddialı (oran %.2f)', odds)
           ELSE format_string('Piyasa oranı %.2f — model ile uyumlu', odds) END,
      CASE WHEN market IN ('1X2', 'double_chance') AND selection IN ('1', '1X') THEN
             CASE WHEN {h} >= 0.6D THEN {_top_stake('h', 'ev sahibi')}
                  WHEN a_dead_rubber >= 0.5D THEN format_string('Deplasman takımı dead rubber (%.0f%%)', a_dead_rubber * 100) END
           WHEN market IN ('1X2', 'double_chance') AND selection IN ('2', 'X2') THEN
             CASE WHEN {a} >= 0.6D THEN {_top_stake('a', 'deplasman')}
                  WHEN h_dead_rubber >= 0.5D THEN format_string('Ev sahibi dead rubber (%.0f%%)', h_dead_rubber * 100) END
           WHEN {goals} AND selection IN ('over', 'yes') AND (h_intensity + a_intensity) / 2 >= 0.5D THEN
             format_string('İki takımın da oynayacağı bir şey var (intensity %.0f%%)', (h_intensity + a_intensity) * 50)
           WHEN {goals} AND selection IN ('under', 'no') AND (h_dead_rubber + a_dead_rubber) / 2 >= 0.4D THEN
             'İki takım da dead rubber — gol beklentisi düşük' END,
      CASE WHEN market = '1X2' AND selection = '1' AND h_form_delta >= 0.25D AND a_form_delta <= 0 AND h_form_reason IS NOT NULL THEN concat('Ev: ', h_form_reason)
           WHEN market = '1X2' AND selection = '2' AND a_form_delta >= 0.25D AND h_form_delta <= 0 AND a_form_reason IS NOT NULL THEN concat('Dep: ', a_form_reason) END,
      CASE WHEN market = '1X2' AND selection = '1' AND a_key_name IS NOT NULL AND a_absent >= 2 THEN concat('Deplasmanda ', a_key_name, ' yok')
           WHEN market = '1X2' AND selection = '2' AND h_key_name IS NOT NULL AND h_absent >= 2 THEN concat('Ev sahibinde ', h_key_name, ' yok') END))"""


def key_absence() -> str:
    """SQL text, an aggregate over all absences of a team: the first in a decisive position, by name (or position when unnamed)."""
    test = " OR ".join(f"startswith(lower(position), '{p}')" for p in KEY_POSITIONS)
    return f"min_by(coalesce(nullif(name, ''), position), IF({test}, idx, NULL))"


def with_neutral_signals(df: DataFrame) -> DataFrame:
    """Missing context counts as no signal."""
    fill = {}
    for s in "ha":
        for c in ("relegation_risk", "title_push", "europe_push", "dead_rubber", "intensity", "form_delta"):
            fill[f"{s}_{c}"] = F.coalesce(F.col(f"{s}_{c}"), F.lit(0.0)) if f"{s}_{c}" in df.columns else F.lit(0.0)
        fill[f"{s}_absent"] = F.coalesce(F.col(f"{s}_absent"), F.lit(0)) if f"{s}_absent" in df.columns else F.lit(0)
        for c in ("key_name", "form_reason", "team"):
            if f"{s}_{c}" not in df.columns:
                fill[f"{s}_{c}"] = F.lit(None).cast("string")
    return df.withColumns(fill)


def _policy(pos: int, policy: dict, default: str) -> str:
    if not policy:
        return default
    show = (lambda v: "array(" + ", ".join(f"'{x}'" for x in v) + ")") if pos == 0 else (lambda v: f"{float(v)}D")
    return "CASE league " + " ".join(f"WHEN '{lg}' THEN {show(p[pos])}" for lg, p in policy.items()) + f" ELSE {default} END"


def enumerate_picks(matches: DataFrame, best: DataFrame, curve: DataFrame | None = None, *, min_prob: float = 0.55,
                    require_edge: bool = True, allowed=None, policy=None, compat_base_market: bool = False,
                    with_reasons: bool = True, context=None) -> DataFrame:
    """All picks of the given matches (needs lam, mu, rho; h_*/a_* signals are optional).

    ``context`` is a function that joins the signals onto rows of picks. It runs after every
    gate, so only surviving picks travel through its joins.

    The strict pass keeps only leagues with a verified strategy and prices that beat the
    market; the open pass takes every pick above the probability floor and prices a missing
    one at 1/prob.
    """
    policy = LEAGUE_POLICY if policy is None else policy
    pool = matches
    if require_edge:
        pool = pool.filter(F.col("league").isin(list(policy)))
    families = allowed
    if require_edge:
        named = {f for p in policy.values() for f in p[0]}
        families = named if families is None else named & set(families)
    wanted = [m for m in mk.ENUMERATED if families is None or _family(m, compat_base_market) in families]
    how = "inner" if require_edge else "left"
    probs = mk.long_book(od.with_prices(pool, best, wanted, how), wanted)
    probs = probs.withColumn("base", naming.base_market(F.col("market"), compat_base_market))
    if require_edge:
        probs = probs.filter(F.expr(f"array_contains({_policy(0, policy, 'array()')}, base)"))
    if curve is not None:
        probs = calibrate.apply_curve(probs, curve, "prob")
    floor = f"greatest({min_prob}D, {_policy(2, policy, '0D')})" if require_edge else f"{min_prob}D"
    probs = probs.filter(F.expr(f"prob >= {floor}"))
    x = od.priced(probs, how)
    x = x.withColumn("synthetic", F.col("odds").isNull())
    x = x.selectExpr(
        *[f"`{c}`" for c in x.columns if c not in ("odds", "overround")], "coalesce(odds, 1D / prob) AS odds",
        "IF(synthetic, 0D, prob / ((1D / odds) / coalesce(overround, 1D)) - 1D) AS edge")
    if require_edge:
        x = x.filter(F.expr(f"edge >= greatest({MIN_VALUE_EDGE}D, {_policy(1, policy, '0D')})"))
    x = with_neutral_signals(context(x) if context else x)
    x = x.selectExpr("*", f"{motivation_score()} AS motivation_score", f"{form_score()} AS form_score",
                     f"{availability_score()} AS availability_score")
    out = ["match_id", "league", "kickoff", "market", "selection", "ord", "base", "prob", "odds", "edge", "synthetic",
           "motivation_score", "form_score", "availability_score", f"{composite()} AS composite"]
    if with_reasons:
        out.append(f"{reasons()} AS reasons")
    return x.selectExpr(*out)


def _family(market: str, compat: bool) -> str:
    if market.startswith("over_under"):
        return "over_under"
    return market.split("_", 1)[0] if compat else market


def best_per_match(picks: DataFrame) -> DataFrame:
    """Best composite of each match; ties go to the market listed first."""
    from pyspark.sql import Window
    w = Window.partitionBy("match_id").orderBy(F.round("composite", 9).desc(), "ord")
    return picks.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def absence_summary(rows: DataFrame) -> DataFrame:
    """(match_id, team_id): absent count, the key player among all of them, and the first five for display.

    Count and key player are plain aggregates; only five ranked rows per team are ever collected, so a
    team with any number of rows stays small.
    """
    from pyspark.sql import Window
    counts = rows.groupBy("match_id", "team_id").agg(F.count("*").alias("absent"), F.expr(key_absence()).alias("key_name"))
    w = Window.partitionBy("match_id", "team_id").orderBy("idx")
    top = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("match_id", "team_id").agg(
        F.expr("transform(array_sort(collect_list(struct(rn, name, position, reason))),"
               " x -> struct(x.name AS name, x.position AS position, x.reason AS reason))").alias("key_absences"))
    return counts.join(top, ["match_id", "team_id"])
