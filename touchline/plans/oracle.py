"""DuckDB text of the derived tables, shared by the checking SQL."""
import re

from touchline.plans import derive

_CLUBS = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in derive.CLUBS) + "]"


def _q(s):
    return "'" + s.replace("'", "''") + "'"


CTE = {
    "m": ([], """
      SELECT o_orderkey AS match_id, 'L' || CAST(o_custkey % 5 AS VARCHAR) AS league,
        CAST(year(o_orderdate) AS VARCHAR) AS season, o_orderdate AS kickoff,
        (o_custkey % 5) * 100 + o_orderkey % 20 AS home_team_id,
        (o_custkey % 5) * 100 + (o_orderkey % 20 + 1 + o_custkey % 19) % 20 AS away_team_id,
        CASE WHEN o_orderstatus <> 'P' THEN 'finished' ELSE 'scheduled' END AS status,
        CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 7 + o_custkey * 3) % 5 END AS ft_home,
        CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 11 + o_custkey * 5) % 4 END AS ft_away,
        CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 THEN
          round(greatest(0.05e0, (o_orderkey * 7 + o_custkey * 3) % 5 + (o_orderkey % 7 - 3) / 10.0e0), 6) END AS xg_home,
        CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 THEN
          round(greatest(0.05e0, (o_orderkey * 11 + o_custkey * 5) % 4 + (o_orderkey % 7 - 3) / 10.0e0), 6) END AS xg_away
      FROM orders"""),
    "lm": (["m"], """
      SELECT match_id, league, season, kickoff, home_team_id, away_team_id, ft_home, ft_away,
        CASE WHEN status = 'scheduled' AND match_id % 3 = 1 THEN 'in_play'
             WHEN status = 'scheduled' AND match_id % 3 = 2 THEN 'paused' ELSE status END AS status,
        CASE WHEN status = 'scheduled' AND match_id % 3 <> 0 THEN match_id % 90 + 1 END AS live_minute,
        CASE WHEN status = 'scheduled' AND match_id % 3 <> 0 AND match_id % 5 <> 0 THEN match_id % 4 END AS live_home,
        CASE WHEN status = 'scheduled' AND match_id % 3 <> 0 AND match_id % 5 <> 0 THEN (match_id * 3) % 3 END AS live_away
      FROM m"""),
    "r": (["m"], """
      SELECT *, -0.1e0 AS rho,
        exp(((home_team_id * 37) % 21 - 10) / 25.0e0 + ((away_team_id * 53) % 21 - 10) / 25.0e0 + 0.35e0) AS lam,
        exp(((away_team_id * 37) % 21 - 10) / 25.0e0 + ((home_team_id * 53) % 21 - 10) / 25.0e0 + 0.1e0) AS mu
      FROM m"""),
    "pair_rates": (["r"], "SELECT DISTINCT home_team_id, away_team_id, lam, mu, rho FROM r"),
    "pair_cells": (["pair_rates"], """
      SELECT home_team_id, away_team_id, i, j, w / sum(w) OVER (PARTITION BY home_team_id, away_team_id) AS p FROM (
        SELECT home_team_id, away_team_id, i, j,
          exp(-lam) * pow(lam, i) / factorial(CAST(i AS INTEGER)) * exp(-mu) * pow(mu, j) / factorial(CAST(j AS INTEGER))
          * CASE WHEN i = 0 AND j = 0 THEN greatest(1 - lam * mu * rho, 1e-10)
                 WHEN i = 0 AND j = 1 THEN greatest(1 + lam * rho, 1e-10)
                 WHEN i = 1 AND j = 0 THEN greatest(1 + mu * rho, 1e-10)
                 WHEN i = 1 AND j = 1 THEN greatest(1 - rho, 1e-10) ELSE 1.0e0 END AS w
        FROM pair_rates, range(0, 11) a(i), range(0, 11) b(j)) z"""),
    "pair_wide": (["pair_cells"], """
      SELECT home_team_id, away_team_id,
        sum(CASE WHEN i > j THEN p ELSE 0 END) AS hw, sum(CASE WHEN i = j THEN p ELSE 0 END) AS dr,
        sum(CASE WHEN i < j THEN p ELSE 0 END) AS aw,
        """ + ", ".join(f"sum(CASE WHEN i + j > {l} THEN p ELSE 0 END) AS o{int(l)}, "
                        f"sum(CASE WHEN i + j < {l} THEN p ELSE 0 END) AS u{int(l)}" for l in (0.5, 1.5, 2.5, 3.5, 4.5)) + """,
        sum(CASE WHEN i >= 1 AND j >= 1 THEN p ELSE 0 END) AS bt,
        sum(CASE WHEN (i + j) % 2 = 1 THEN p ELSE 0 END) AS od,
        sum(CASE WHEN i + j <= 1 THEN p ELSE 0 END) AS g1,
        sum(CASE WHEN i + j BETWEEN 2 AND 3 THEN p ELSE 0 END) AS g3,
        sum(CASE WHEN i + j BETWEEN 4 AND 6 THEN p ELSE 0 END) AS g6,
        sum(CASE WHEN i + j >= 7 THEN p ELSE 0 END) AS g7,
        sum(CASE WHEN i > 1.5 THEN p ELSE 0 END) AS ho, sum(CASE WHEN j > 1.5 THEN p ELSE 0 END) AS ao,
        sum(CASE WHEN i - j = 1 THEN p ELSE 0 END) AS d1, sum(CASE WHEN i - j = -1 THEN p ELSE 0 END) AS dm1
      FROM pair_cells GROUP BY home_team_id, away_team_id"""),
    "pair_long": (["pair_wide"], "SELECT w.home_team_id, w.away_team_id, x.market, x.selection, x.ord, x.prob FROM pair_wide w, LATERAL (VALUES "
        + ", ".join(f"('{mk}', '{s}', {n}, {e})" for n, (mk, s, e) in enumerate(
            [("1X2", "1", "w.hw"), ("1X2", "X", "w.dr"), ("1X2", "2", "w.aw"), ("double_chance", "1X", "w.hw + w.dr"),
             ("double_chance", "12", "w.hw + w.aw"), ("double_chance", "X2", "w.dr + w.aw")]
            + [(f"over_under_{l}.5", s, f"w.{s[0]}{l}") for l in range(5) for s in ("over", "under")]
            + [("btts", "yes", "w.bt"), ("btts", "no", "1 - w.bt"), ("odd_even", "odd", "w.od"), ("odd_even", "even", "1 - w.od"),
               ("goal_range", "0-1", "w.g1"), ("goal_range", "2-3", "w.g3"), ("goal_range", "4-6", "w.g6"), ("goal_range", "7+", "w.g7"),
               ("asian_handicap_0", "home", "w.hw + w.dr / 2"), ("asian_handicap_0", "away", "w.aw + w.dr / 2"),
               ("asian_handicap_-0.5", "home", "w.hw"), ("asian_handicap_-0.5", "away", "w.aw + w.dr"),
               ("asian_handicap_-1", "home", "w.hw - w.d1 / 2"), ("asian_handicap_-1", "away", "w.aw + w.dr + w.d1 / 2"),
               ("asian_handicap_+0.5", "home", "w.hw + w.dr"), ("asian_handicap_+0.5", "away", "w.aw"),
               ("asian_handicap_+1", "home", "w.hw + w.dr + w.dm1 / 2"), ("asian_handicap_+1", "away", "w.aw - w.dm1 / 2"),
               ("home_over_under_1.5", "over", "w.ho"), ("home_over_under_1.5", "under", "1 - w.ho"),
               ("away_over_under_1.5", "over", "w.ao"), ("away_over_under_1.5", "under", "1 - w.ao")]))
        + ") x(market, selection, ord, prob)"),
    "mp": (["m", "pair_long"], """
      SELECT m.match_id, m.league, m.season, m.kickoff, m.status, m.ft_home, m.ft_away, m.home_team_id, m.away_team_id,
        x.market, x.selection, x.ord, x.prob
      FROM m JOIN pair_long x ON m.home_team_id = x.home_team_id AND m.away_team_id = x.away_team_id"""),
    "odds": (["m"], """
      SELECT match_id * 100 + sx * 10 + qx AS odds_id, match_id, source, market, selection,
        1.3e0 + ((match_id * 13 + sx * 37 + qx * 11) % 300) / 100.0e0 AS decimal_odds,
        kickoff - to_hours(qx) AS fetched_at
      FROM m, (VALUES ('1X2', '1', 1), ('1X2', 'X', 2), ('1X2', '2', 3), ('OU_2.5', 'over', 4), ('OU_2.5', 'under', 5)) s(market, selection, sx),
        (VALUES ('PSC', 1), ('B365C', 2), ('B365', 3)) q(source, qx)
      WHERE (match_id + qx) % 3 <> 0"""),
    "best": (["odds"], """
      SELECT match_id, market, selection, decimal_odds AS odds FROM (
        SELECT match_id, replace(market, 'OU_', 'over_under_') AS market, selection, decimal_odds,
          row_number() OVER (PARTITION BY match_id, market, selection ORDER BY
            CASE source WHEN 'B365C' THEN 0 WHEN 'PSC' THEN 1 WHEN 'B365' THEN 2 WHEN 'PS' THEN 3 WHEN 'WH' THEN 4 ELSE 99 END,
            odds_id DESC) AS rn
        FROM odds) z WHERE rn = 1"""),
    "overround": (["best"], """
      SELECT match_id, market, CASE WHEN count(*) = CASE WHEN market = '1X2' THEN 3 ELSE 2 END THEN sum(1 / odds) ELSE 1.0e0 END AS vig
      FROM best GROUP BY match_id, market"""),
    "tm": (["m"], """
      SELECT league, season, match_id, kickoff, status, home_team_id AS team_id, away_team_id AS opp_id, 1 AS is_home, ft_home AS gf, ft_away AS ga FROM m
      UNION ALL
      SELECT league, season, match_id, kickoff, status, away_team_id, home_team_id, 0, ft_away, ft_home FROM m"""),
    "teams": (["m"], f"""
      SELECT team_id, ({_CLUBS})[CAST(team_id % 20 AS INTEGER) + 1] AS name, league, 'C' || substr(league, 2) AS country FROM (
        SELECT DISTINCT league, home_team_id AS team_id FROM m UNION SELECT DISTINCT league, away_team_id FROM m) z"""),
    "feed": ([], """
      SELECT event_id, user_id AS match_id, ts AS event_time,
        CASE WHEN event_type IN ('view', 'click') THEN 'IN_PLAY' WHEN event_type = 'signup' THEN 'PAUSED'
             WHEN event_type = 'purchase' THEN 'FINISHED' ELSE 'TIMED' END AS status,
        event_id % 4 AS home_goals, (event_id * 7) % 3 AS away_goals,
        CAST(event_id % 90 AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN '+2' ELSE '' END AS minute
      FROM events"""),
    "prov": (["m"], f"""
      SELECT match_id * 10 AS row_id, match_id AS true_match_id, league,
        CASE (match_id) % 6 WHEN 0 THEN hn WHEN 1 THEN ha WHEN 2 THEN upper(hn) || ' FC' WHEN 3 THEN hn || ' City'
          WHEN 4 THEN hn || 'x' ELSE 'Unknown ' || CAST(match_id % 97 AS VARCHAR) END AS home_name,
        CASE (match_id + 1) % 6 WHEN 0 THEN an WHEN 1 THEN aa WHEN 2 THEN upper(an) || ' FC' WHEN 3 THEN an || ' City'
          WHEN 4 THEN an || 'x' ELSE 'Unknown ' || CAST(match_id % 97 AS VARCHAR) END AS away_name,
        kickoff + to_minutes((match_id % 11 - 5) * 60) AS kickoff, match_id % 5 AS home_goals, match_id % 3 AS away_goals
      FROM (SELECT *, {{alias_h}} AS ha, {{alias_a}} AS aa FROM (
        SELECT *, ({_CLUBS})[CAST(home_team_id % 20 AS INTEGER) + 1] AS hn, ({_CLUBS})[CAST(away_team_id % 20 AS INTEGER) + 1] AS an FROM m) y) z"""
        .replace("{alias_h}", "CASE hn " + " ".join(f"WHEN {_q(v)} THEN {_q(a)}" for a, v in derive.ALIASES.items()) + " ELSE hn END")
        .replace("{alias_a}", "CASE an " + " ".join(f"WHEN {_q(v)} THEN {_q(a)}" for a, v in derive.ALIASES.items()) + " ELSE an END")),
    "alias": ([], "SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(v)})" for a, v in derive.ALIASES.items()) + ") v(alias, name)"),
    "absn": (["m"], """
      SELECT match_id, kickoff, team_id, idx, 'P' || CAST(team_id AS VARCHAR) || '-' || CAST(idx AS VARCHAR) AS name,
        (['Midfielder', 'Goalkeeper', 'Forward', 'Defender'])[CAST((match_id // 4 + idx) % 4 AS INTEGER) + 1] AS position,
        (['Missing Fixture', 'Suspended', 'Red Card', 'Questionable', 'Flu'])[CAST(idx % 5 AS INTEGER) + 1] AS reason
      FROM (SELECT match_id, kickoff, home_team_id AS team_id, 0 AS s FROM m WHERE match_id % 4 = 0 AND match_id % 5 > 0
            UNION ALL SELECT match_id, kickoff, away_team_id, 1 FROM m WHERE match_id % 4 = 0 AND match_id % 5 > 0) z,
        range(1, 8) g(idx) WHERE idx <= (match_id + s) % 8"""),
    "sev": ([], """
      SELECT CASE WHEN event_id % 10 = 9 THEN NULL ELSE 'ev:' || CAST(event_id AS VARCHAR) END AS external_ref,
        (['basketball', 'tennis', 'volleyball'])[CAST(event_id % 3 AS INTEGER) + 1] AS sport,
        (['NBA', 'BSL'])[CAST(user_id % 2 AS INTEGER) + 1] AS league, ts + to_days(CAST(event_id % 7 AS INTEGER)) AS kickoff,
        'Home ' || CAST(user_id % 30 AS VARCHAR) AS home_team, 'Away ' || CAST(event_id % 30 AS VARCHAR) AS away_team,
        CASE WHEN event_id % 4 = 0 THEN 'finished' WHEN event_id % 4 = 1 THEN 'in_play' ELSE 'scheduled' END AS status, event_id
      FROM events"""),
}


def sql(names, body: str) -> str:
    """``WITH`` the named derived tables (and what they need) in front of ``body``."""
    order: list = []

    def visit(n):
        if n in order:
            return
        for dep in CTE[n][0]:
            visit(dep)
        order.append(n)

    for n in names.split():
        visit(n)
    own = {n: re.search(rf"\b(?:FROM|JOIN) {n}\b", CTE[n][1]) for n in order}  # a table that reads itself is recursive
    return f"WITH {'RECURSIVE ' if any(own.values()) else ''}" + ",\n".join(f"{n} AS {'' if own[n] else 'MATERIALIZED '}({CTE[n][1]})" for n in order) + ("\n" if not body.lstrip().startswith(",") else "") + body


def hit_sql(market="market", selection="selection", fh="ft_home", fa="ft_away") -> str:
    """Settlement as a CASE expression."""
    r = f"CASE WHEN {fh} > {fa} THEN '1' WHEN {fh} < {fa} THEN '2' ELSE 'X' END"
    return f"""CASE WHEN {fh} IS NULL OR {fa} IS NULL THEN NULL
      WHEN {market} = '1X2' THEN {selection} = {r}
      WHEN {market} = 'double_chance' THEN contains({selection}, {r})
      WHEN {market} LIKE 'over_under_%' THEN {selection} = CASE WHEN {fh} + {fa} > TRY_CAST(substr({market}, 12) AS DOUBLE) THEN 'over' ELSE 'under' END
      WHEN {market} = 'btts' THEN {selection} = CASE WHEN {fh} > 0 AND {fa} > 0 THEN 'yes' ELSE 'no' END
      WHEN {market} = 'odd_even' THEN {selection} = CASE WHEN ({fh} + {fa}) % 2 = 1 THEN 'odd' ELSE 'even' END
      ELSE FALSE END"""
