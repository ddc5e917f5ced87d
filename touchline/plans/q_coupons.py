"""Queries: picks, scores, reasons, coupons, history, settlement (M6)."""
from pyspark.sql import functions as F

from touchline.functions import settle
from touchline.operators import compose as co
from touchline.operators import features as ft
from touchline.operators import markets as mk
from touchline.operators import odds as od
from touchline.operators import picks as pk
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, hit_sql, sql
from touchline.plans.q_evaluate import _RESULT, _bins_sql, ev
from touchline.plans.q_features import day
from touchline.plans.q_markets import r6
from touchline.plans.registry import query

POLICY = {"L0": (["over_under"], 0.03, 0.55), "L1": (["over_under"], 0.03, 0.60), "L2": (["1X2"], 0.01, 0.50)}


def with_context(spark, d, rows):
    """Both sides' motivation, form and availability on rows that carry the match's keys."""
    full = D.matches(spark, d)
    form = ft.form_before(full).withColumn("form_reason", F.expr(f"try_element_at({ft.form_reasons()}, 1)"))
    keys = ["league", "season", "kickoff", "team_id"]
    # one feature row per team and kickoff, so each side costs one join
    side = ft.motivation_before(full).select(*keys, *ft.SIGNALS).join(form.select(*keys, "form_delta", "form_reason"), keys, "left")
    x = ft.attach_sides(rows, side, [*ft.SIGNALS, "form_delta", "form_reason"], "context")
    av = pk.absence_summary(D.absences(spark, d)).select("match_id", "team_id", "absent", "key_name")
    for s, p in (("home", "h"), ("away", "a")):
        x = x.join(av.selectExpr("match_id", f"team_id AS {s}_team_id", f"absent AS {p}_absent", f"key_name AS {p}_key_name"),
                   ["match_id", f"{s}_team_id"], "left")
    return x.withColumns({"h_team": F.concat(F.lit("T"), F.col("home_team_id").cast("string")),
                          "a_team": F.concat(F.lit("T"), F.col("away_team_id").cast("string"))})


def played(spark, d):
    return D.matches(spark, d).filter("status = 'finished' AND ft_home IS NOT NULL AND ft_away IS NOT NULL")


def strict_picks(spark, d, context=False, reasons=False):
    x = pk.enumerate_picks(D.with_rates(played(spark, d)), od.best_prices(D.odds(spark, d)), policy=POLICY, with_reasons=reasons,
                           context=(lambda rows: with_context(spark, d, rows)) if context else None)
    return x.withColumn("day", F.date_format("kickoff", "yyyy-MM-dd"))


def open_picks(spark, d, min_prob=0.55, reasons=False):
    x = pk.enumerate_picks(D.with_rates(played(spark, d)), od.best_prices(D.odds(spark, d)), min_prob=min_prob,
                           require_edge=False, with_reasons=reasons)
    return x.withColumn("day", F.date_format("kickoff", "yyyy-MM-dd"))


_E = "greatest(-0.3e0, least(0.3e0, edge)) / 0.3e0"
_DAY = "strftime(kickoff, '%Y-%m-%d')"
CTE["strict"] = (["mp", "best", "overround"], f"""
  SELECT *, 0.15e0 * prob + 0.45e0 * (0.5e0 + 0.5e0 * {_E}) + 0.2e0 AS composite FROM (
    SELECT match_id, league, kickoff, market, selection, ord, CASE WHEN market LIKE 'over_under%' THEN 'over_under' ELSE market END AS base,
      prob, odds, prob / ((1 / odds) / vig) - 1 AS edge, ft_home, ft_away FROM mp JOIN best USING (match_id, market, selection) JOIN overround USING (match_id, market)
    WHERE ft_home IS NOT NULL) z JOIN (VALUES ('L0', 'over_under', 0.03e0, 0.55e0), ('L1', 'over_under', 0.03e0, 0.6e0), ('L2', '1X2', 0.01e0, 0.5e0)) p(league, base, me, mpr)
    USING (league, base) WHERE prob >= 0.55e0 AND prob >= mpr AND edge >= greatest(0.03e0, me)""")
CTE["open_"] = (["mp", "best", "overround"], f"""
  SELECT *, 0.15e0 * prob + 0.45e0 * (0.5e0 + 0.5e0 * {_E}) + 0.2e0 AS composite FROM (
    SELECT match_id, league, kickoff, {_DAY} AS day, market, selection, ord, CASE WHEN market LIKE 'over_under%' THEN 'over_under' ELSE market END AS base,
      prob, coalesce(odds, 1 / prob) AS odds, odds IS NULL AS synthetic, CASE WHEN odds IS NULL THEN 0e0 ELSE prob / ((1 / odds) / coalesce(vig, 1)) - 1 END AS edge
    FROM mp LEFT JOIN best USING (match_id, market, selection) LEFT JOIN overround USING (match_id, market)
    WHERE ft_home IS NOT NULL AND (market IN ('1X2', 'double_chance', 'btts', 'odd_even') OR market LIKE 'over_under_%') AND prob >= 0.55e0) z""")
CTE["openbest"] = (["open_"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(composite, 9) DESC, ord) AS rn FROM open_) z WHERE rn = 1")


@query("p8_strict_picks", sql("strict", """
SELECT match_id, market, selection, round(prob, 6) AS prob, odds, round(edge, 6) AS edge, round(composite, 6) AS composite FROM strict"""))
def p8_strict_picks(spark, d):
    """League policy, probability floor, edge floor."""
    return strict_picks(spark, d).select("match_id", "market", "selection", r6("prob", "prob"), "odds", r6("edge", "edge"), r6("composite", "composite"))


@query("f13_open_picks", sql("open_", """
SELECT match_id, market, selection, round(prob, 6) AS prob, round(odds, 6) AS odds, CAST(synthetic AS INTEGER) AS synthetic, round(edge, 6) AS edge, round(composite, 6) AS composite FROM open_"""))
def f13_open_picks(spark, d):
    return open_picks(spark, d).select("match_id", "market", "selection", r6("prob", "prob"), r6("odds", "odds"),
                                       F.col("synthetic").cast("int").alias("synthetic"), r6("edge", "edge"), r6("composite", "composite"))


@query("f12_context_scores", sql("strict sig absn m", f""",
 av AS (SELECT match_id, team_id, count(*) AS absent FROM absn GROUP BY match_id, team_id),
 x AS (SELECT s.*, g.* EXCLUDE (match_id), coalesce(va.absent, 0) AS h_abs, coalesce(vb.absent, 0) AS a_abs
   FROM strict s JOIN m USING (match_id) JOIN sig g ON g.match_id = s.match_id
   LEFT JOIN av va ON va.match_id = s.match_id AND va.team_id = m.home_team_id LEFT JOIN av vb ON vb.match_id = s.match_id AND vb.team_id = m.away_team_id),
 y AS (SELECT *, CASE WHEN base = '1X2' AND selection = '1' THEN least(1, greatest(h_rel, h_tit, h_eur) + 0.5e0 * a_dead)
      WHEN base = '1X2' AND selection = '2' THEN least(1, greatest(a_rel, a_tit, a_eur) + 0.5e0 * h_dead)
      WHEN base = '1X2' THEN 0
      WHEN selection = 'over' THEN CASE WHEN (h_int + a_int) / 2 >= 0.5e0 THEN (h_int + a_int) / 2 WHEN (h_dead + a_dead) / 2 >= 0.4e0 THEN -(h_dead + a_dead) / 2 ELSE 0 END
      ELSE CASE WHEN (h_dead + a_dead) / 2 >= 0.4e0 THEN (h_dead + a_dead) / 2 ELSE 0 END END AS mot,
    CASE WHEN base = '1X2' AND selection = '1' THEN greatest(-1, least(1, h_fd - a_fd)) WHEN base = '1X2' AND selection = '2' THEN greatest(-1, least(1, a_fd - h_fd))
      WHEN base = '1X2' THEN -greatest(abs(h_fd), abs(a_fd)) WHEN selection = 'over' THEN 0.5e0 * (h_fd + a_fd) ELSE -0.5e0 * (h_fd + a_fd) END AS frm,
    CASE WHEN base = '1X2' AND selection = '1' THEN greatest(-3, least(3, a_abs - h_abs)) / 3e0 WHEN base = '1X2' AND selection = '2' THEN -greatest(-3, least(3, a_abs - h_abs)) / 3e0
      WHEN base = '1X2' THEN -abs(greatest(-3, least(3, a_abs - h_abs)) / 3e0) * 0.5e0
      WHEN greatest(h_abs, a_abs) >= 3 THEN CASE WHEN selection = 'over' THEN -0.5e0 ELSE 0.5e0 END ELSE 0e0 END AS avl FROM x)
SELECT match_id, market, selection, round(mot, 6) AS motivation_score, round(frm, 6) AS form_score, round(avl, 6) AS availability_score,
  round(0.15e0 * prob + 0.45e0 * (0.5e0 + 0.5e0 * {_E}) + 0.2e0 * (0.5e0 + 0.5e0 * mot) + 0.1e0 * (0.5e0 + 0.5e0 * frm) + 0.1e0 * (0.5e0 + 0.5e0 * avl), 6) AS composite FROM y"""))
def f12_context_scores(spark, d):
    """F9, F10, F11 signal scores and the F12 composite."""
    x = strict_picks(spark, d, context=True)
    return x.select("match_id", "market", "selection", *[r6(c, c) for c in ("motivation_score", "form_score", "availability_score", "composite")])


@query("f28_pick_reasons", sql("strict", """
SELECT match_id, market, selection, 'Model olasılığı %' || printf('%.0f', prob * 100) || ' / ' ||
  CASE WHEN edge > 0.03e0 THEN 'Piyasa oranı ' || printf('%.2f', odds) || ' (impl %' || printf('%.0f', 100 / odds) || ') — model %' || printf('%.0f', edge * 100) || ' edge görüyor'
       ELSE 'Piyasa oranı ' || printf('%.2f', odds) || ' — model ile uyumlu' END AS reasons FROM strict"""))
def f28_pick_reasons(spark, d):
    x = strict_picks(spark, d, reasons=True)
    return x.select("match_id", "market", "selection", F.array_join("reasons", " / ").alias("reasons"))


@query("f28_context_reasons")
def f28_context_reasons(spark, d):
    x = strict_picks(spark, d, context=True, reasons=True)
    return x.select("match_id", "market", "selection", F.array_join("reasons", " / ").alias("reasons"))


@query("w9_best_pick_per_match", sql("openbest", "SELECT match_id, market, selection, round(composite, 6) AS composite FROM openbest"))
def w9_best_pick_per_match(spark, d):
    return pk.best_per_match(open_picks(spark, d)).select("match_id", "market", "selection", r6("composite", "composite"))


@query("t3_top_singles", sql("strict", """
SELECT match_id, market, selection, round(composite, 6) AS composite FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(composite, 9) DESC, ord) AS rn FROM strict) z WHERE rn = 1
ORDER BY round(z.composite, 9) DESC, match_id LIMIT 5"""))
def t3_top_singles(spark, d):
    return co.singles(strict_picks(spark, d)).select("match_id", "market", "selection", r6("composite", "composite"))


def composed(spark, d):
    return co.compose(strict_picks(spark, d), num_legs=2, max_coupons=3)


@query("t5_composed_legs")
def t5_composed_legs(spark, d):
    return composed(spark, d)


@query("t6_suggested_coupons")
def t6_suggested_coupons(spark, d):
    legs = co.suggest(strict_picks(spark, d), open_picks(spark, d))
    return co.coupon_headers(legs)


def _variant_sql():
    """The three variants as chained ranked pools and self-joins."""
    parts, used = [], []
    for key, mp_, lo, hi in co.VARIANTS:
        anti = "".join(f" AND NOT EXISTS (SELECT 1 FROM b_{u} u WHERE u.day = o.day AND (u.m1 = o.match_id OR u.m2 = o.match_id))" for u in used)
        parts.append(f"""p_{key} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(prob, 9) DESC, match_id) AS r FROM openbest o WHERE TRUE{anti}) z)""")
        parts.append(f"""b_{key} AS (SELECT * FROM (SELECT a.day, a.match_id AS m1, b.match_id AS m2, a.prob * b.prob AS cp, a.odds * b.odds AS co,
          row_number() OVER (PARTITION BY a.day ORDER BY round(a.prob * b.prob, 12) DESC, a.r, b.r) AS k
          FROM p_{key} a JOIN p_{key} b ON a.day = b.day AND a.r < b.r AND a.base <> b.base
          WHERE a.odds * b.odds BETWEEN {lo} AND {hi} AND a.prob * b.prob >= {mp_}) z WHERE k = 1)""")
        used.append(key)
    sel = " UNION ALL ".join(f"SELECT day, '{k}' AS variant, m1, m2, round(cp, 6) AS combined_prob, round(co, 6) AS combined_odds FROM b_{k}" for k in used)
    return ", " + ",\n".join(parts) + "\n" + sel


@query("t7_hit_variants", sql("openbest", _variant_sql()))
def t7_hit_variants(spark, d):
    """Also J24: leg combinations inside a day's pool."""
    v = co.hit_variants(open_picks(spark, d))
    return v.select("day", "variant", F.col("ids")[0].alias("m1"), F.col("ids")[1].alias("m2"), r6("combined_prob", "combined_prob"), r6("combined_odds", "combined_odds"))


# derived coupons: per match m, a coupon of m % 3 + 1 legs on this and the next matches
_COUPON = """
  SELECT match_id AS coupon_id, strftime(kickoff, '%Y-%m-%d') AS generated_on, CASE WHEN match_id % 3 = 0 THEN 'primary' WHEN match_id % 3 = 1 THEN 'alternative' ELSE 'fallback' END AS kind,
    g.k AS leg_no, match_id + g.k AS leg_match, CASE (match_id + g.k) % 3 WHEN 0 THEN '1X2' WHEN 1 THEN 'over_under_2.5' ELSE 'btts' END AS market,
    CASE (match_id + g.k) % 3 WHEN 0 THEN '1' WHEN 1 THEN 'over' ELSE 'yes' END AS selection,
    0.4e0 + (match_id % 50) / 100e0 AS prob, CASE WHEN match_id % 10 = 9 THEN NULL ELSE 1.2e0 + (match_id + g.k) % 90 / 100e0 END AS odds, (match_id % 80) / 100e0 AS composite
  FROM m, range(0, 3) g(k) WHERE g.k <= match_id % 3"""
CTE["legs"] = (["m"], _COUPON)
CTE["slegs"] = (["legs"], f"""
  SELECT l.*, CASE WHEN m.match_id IS NULL THEN NULL ELSE {hit_sql('l.market', 'l.selection', 'm.ft_home', 'm.ft_away')} END AS hit, m.ft_home, m.ft_away, m.status AS match_status,
    m.kickoff AS leg_kickoff, m.match_id AS found, m.home_team_id, m.away_team_id
  FROM legs l LEFT JOIN m ON m.match_id = l.leg_match""")
CTE["coup"] = (["slegs"], """
  SELECT coupon_id, generated_on, kind, count(*) AS num_legs, product(prob) AS combined_prob, CASE WHEN coupon_id % 10 = 9 THEN NULL ELSE product(coalesce(odds, 1 / prob)) END AS combined_odds,
    avg(composite) AS avg_composite, CASE WHEN count(*) FILTER (WHERE hit IS NULL) = 0 THEN bool_and(hit) END AS hit
  FROM slegs GROUP BY coupon_id, generated_on, kind""")


def legs(spark, d):
    m = D.matches(spark, d)
    x = m.selectExpr("match_id AS coupon_id", "date_format(kickoff, 'yyyy-MM-dd') AS generated_on",
                     "CASE WHEN match_id % 3 = 0 THEN 'primary' WHEN match_id % 3 = 1 THEN 'alternative' ELSE 'fallback' END AS kind",
                     "explode(sequence(0, CAST(match_id % 3 AS INT))) AS leg_no")
    return x.selectExpr(
        "*", "coupon_id + leg_no AS match_id",
        "CASE (coupon_id + leg_no) % 3 WHEN 0 THEN '1X2' WHEN 1 THEN 'over_under_2.5' ELSE 'btts' END AS market",
        "CASE (coupon_id + leg_no) % 3 WHEN 0 THEN '1' WHEN 1 THEN 'over' ELSE 'yes' END AS selection",
        "0.4D + (coupon_id % 50) / 100D AS prob", "IF(coupon_id % 10 = 9, NULL, 1.2D + (coupon_id + leg_no) % 90 / 100D) AS odds",
        "(coupon_id % 80) / 100D AS composite")


def settled_legs(spark, d):
    m = D.matches(spark, d).select("match_id", "ft_home", "ft_away", "status", F.col("kickoff").alias("leg_kickoff"), "home_team_id", "away_team_id")
    j = legs(spark, d).join(m, "match_id", "left")
    return j.withColumn("hit", settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away")))


def coupons(spark, d):
    head = settled_legs(spark, d).groupBy("coupon_id", "generated_on", "kind").agg(
        F.count("*").alias("num_legs"), F.product("prob").alias("combined_prob"), F.product(F.coalesce("odds", F.lit(1.0) / F.col("prob"))).alias("co"),
        F.avg("composite").alias("avg_composite"), F.expr("IF(count_if(hit IS NULL) = 0, bool_and(hit), NULL)").alias("hit"))
    return head.withColumn("combined_odds", F.expr("IF(coupon_id % 10 = 9, NULL, co)")).drop("co")


@query("a26_combined_odds", sql("legs", """
SELECT coupon_id, count(*) AS num_legs, round(product(prob), 6) AS combined_prob, round(product(coalesce(odds, 1 / prob)), 6) AS combined_odds, round(avg(composite), 6) AS avg_composite
FROM legs GROUP BY coupon_id"""))
def a26_combined_odds(spark, d):
    """Also A27."""
    h = co.coupon_headers(legs(spark, d), ["coupon_id"])
    return h.select("coupon_id", "num_legs", *[r6(c, c) for c in ("combined_prob", "combined_odds", "avg_composite")])


@query("f26_coupon_signature", sql("legs", """
SELECT coupon_id, substr(sha256(string_agg(leg_match || '|' || market || '|' || selection, '||' ORDER BY leg_match || '|' || market || '|' || selection)), 1, 32) AS signature
FROM legs GROUP BY coupon_id"""))
def f26_coupon_signature(spark, d):
    return co.coupon_headers(legs(spark, d), ["coupon_id"]).select("coupon_id", "signature")


@query("a28_coupon_settlement", sql("slegs", """
SELECT coupon_id, count(*) AS num_legs, count(*) FILTER (WHERE hit IS NULL) AS open_legs,
  CAST(CASE WHEN count(*) FILTER (WHERE hit IS NULL) = 0 THEN bool_and(hit) END AS INTEGER) AS hit FROM slegs GROUP BY coupon_id"""))
def a28_coupon_settlement(spark, d):
    s = co.settle_coupons(settled_legs(spark, d))
    return s.select("coupon_id", "num_legs", "open_legs", F.col("hit").cast("int").alias("hit"))


@query("a24_history_summary", sql("coup", """
SELECT count(*) AS total, count(hit) AS settled, count(*) - count(hit) AS pending, count(*) FILTER (WHERE hit) AS won, count(*) FILTER (WHERE NOT hit) AS lost,
  round(count(*) FILTER (WHERE hit) / count(hit), 6) AS win_rate, round(sum(CASE WHEN hit THEN combined_odds - 1 ELSE -1 END) FILTER (WHERE hit IS NOT NULL AND combined_odds IS NOT NULL)
    / count(*) FILTER (WHERE hit IS NOT NULL AND combined_odds IS NOT NULL), 6) AS roi FROM coup WHERE generated_on >= '2000-01-01'"""))
def a24_history_summary(spark, d):
    s = co.history_summary(coupons(spark, d).filter("generated_on >= '2000-01-01'"))
    return s.select("total", "settled", "pending", "won", "lost", r6("win_rate", "win_rate"), r6("roi", "roi"))


@query("p9_history_filter", sql("coup", """
SELECT coupon_id, kind, num_legs FROM coup WHERE generated_on >= '2000-06-01' AND kind = 'primary' AND hit IS NULL"""))
def p9_history_filter(spark, d, since="2000-06-01", kind="primary", status="pending"):
    test = {"pending": "hit IS NULL", "won": "hit", "lost": "NOT hit"}.get(status, "TRUE")
    c = coupons(spark, d).filter(F.col("generated_on") >= since).filter(test)
    return c.filter(F.col("kind") == kind).select("coupon_id", "kind", "num_legs")


@query("p14_leg_view", sql("slegs", """
SELECT coupon_id, leg_no, CASE WHEN found IS NULL THEN '?' ELSE 'T' || home_team_id END AS home_team, coalesce(match_status, 'unknown') AS match_status,
  ft_home || '-' || ft_away AS score, market, selection, CAST(hit AS INTEGER) AS hit FROM slegs"""))
def p14_leg_view(spark, d):
    """Also J20: coupon, legs, matches."""
    s = settled_legs(spark, d)
    return s.selectExpr(
        "coupon_id", "CAST(leg_no AS BIGINT) AS leg_no", "coalesce(concat('T', home_team_id), '?') AS home_team", "coalesce(status, 'unknown') AS match_status",
        "IF(ft_home IS NOT NULL AND ft_away IS NOT NULL, concat(ft_home, '-', ft_away), NULL) AS score", "market", "selection", "CAST(hit AS INT) AS hit")


@query("j20_coupon_documents")
def j20_coupon_documents(spark, d):
    """Coupons with their legs nested (a coupon has at most a handful of legs)."""
    g = settled_legs(spark, d).groupBy("coupon_id").agg(F.expr(
        "array_sort(collect_list(struct(leg_no, match_id, market, selection, prob, odds, hit))) AS legs"))
    return g.select("coupon_id", F.to_json("legs").alias("legs"))


@query("a25_monthly_pnl", sql("coup", """
SELECT coalesce(kind, 'all') AS kind, coalesce(month, 'all') AS month, count(*) AS coupons, round(sum(pnl), 6) AS pnl, round(avg(pnl), 9) AS roi FROM (
  SELECT kind, substr(generated_on, 1, 7) AS month, CASE WHEN hit THEN coalesce(combined_odds, 1) - 1 ELSE -1 END AS pnl FROM coup WHERE hit IS NOT NULL) z
GROUP BY GROUPING SETS ((month), (kind), ())"""))
def a25_monthly_pnl(spark, d):
    """Composer back-test report: by month, by kind, and overall."""
    c = coupons(spark, d).filter("hit IS NOT NULL").selectExpr(
        "kind", "substr(generated_on, 1, 7) AS month", "IF(hit, coalesce(combined_odds, 1D) - 1D, -1D) AS pnl")
    g = c.groupingSets([[F.col("month")], [F.col("kind")], []], "kind", "month").agg(F.count("*").alias("coupons"), F.sum("pnl").alias("pnl"), F.avg("pnl").alias("roi"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("month", F.lit("all")).alias("month"), "coupons", r6("pnl", "pnl"), F.round("roi", 9).alias("roi"))


@query("a25_leg_hit_rates", sql("slegs", """
SELECT CASE WHEN market LIKE 'over_under%' THEN 'over_under' ELSE market END AS market, count(*) AS picks, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate
FROM slegs GROUP BY 1"""))
def a25_leg_hit_rates(spark, d):
    from touchline.functions import naming
    g = settled_legs(spark, d).groupBy(naming.base_market(F.col("market")).alias("market")).agg(F.count("*").alias("picks"), F.count_if("hit").alias("hits"))
    return g.select("market", "picks", "hits", r6(F.col("hits") / F.col("picks"), "hit_rate"))


def strategy_legs(spark, d):
    """Composed coupons of every match day, settled leg by leg."""
    legs_ = co.compose(strict_picks(spark, d), num_legs=2, min_legs=2, max_coupons=3)
    m = D.matches(spark, d).select("match_id", "ft_home", "ft_away")
    return legs_.join(m, "match_id").withColumn("hit", settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away")))


@query("a23_strategy_by_market")
def a23_strategy_by_market(spark, d):
    from touchline.functions import naming
    g = strategy_legs(spark, d).groupBy(naming.base_market(F.col("market")).alias("market")).agg(
        F.count("*").alias("picks"), F.count_if("hit").alias("hits"), F.avg("prob").alias("avg_prob"), F.avg("composite").alias("avg_composite"))
    return g.withColumn("hit_rate", F.col("hits") / F.col("picks"))


@query("a23_strategy_overall")
def a23_strategy_overall(spark, d):
    c = strategy_legs(spark, d).groupBy("day", "coupon_no").agg(
        F.count("*").alias("legs"), F.count_if("hit").alias("hits"), F.expr("bool_and(hit) AS won"), F.product("odds").alias("pays"))
    return c.agg(F.count("*").alias("coupons"), F.count_if("won").alias("coupons_won"), F.sum("legs").alias("legs"), F.sum("hits").alias("legs_hit"),
                 F.avg(F.when(F.col("won"), F.col("pays") - 1.0).otherwise(-1.0)).alias("roi"))


@query("a16_strategy_bins")
def a16_strategy_bins(spark, d):
    return ev.calibration_bins(strategy_legs(spark, d), ev.STRATEGY_EDGES, "prob", ev.STRATEGY_LABELS)


@query("a29_absences", sql("absn", """
SELECT match_id, team_id, count(*) AS absent, string_agg(name, ',' ORDER BY idx) FILTER (WHERE idx <= 5) AS names FROM absn GROUP BY match_id, team_id"""))
def a29_absences(spark, d):
    a = pk.absence_summary(D.absences(spark, d))
    return a.selectExpr("match_id", "team_id", "absent", "array_join(transform(key_absences, x -> x.name), ',') AS names")


@query("j11_availability_lookup", sql("absn m", """,
 av AS (SELECT match_id, team_id, count(*) AS absent, min(idx) FILTER (WHERE position IN ('Goalkeeper', 'Forward')) AS ki FROM absn GROUP BY match_id, team_id)
SELECT m.match_id, coalesce(h.absent, 0) AS h_absent, coalesce(a.absent, 0) AS a_absent, 'P' || h.team_id || '-' || h.ki AS h_key_name
FROM m LEFT JOIN av h ON h.match_id = m.match_id AND h.team_id = m.home_team_id LEFT JOIN av a ON a.match_id = m.match_id AND a.team_id = m.away_team_id"""))
def j11_availability_lookup(spark, d):
    """Also F33: any/filter/slice on the absence list."""
    m = D.matches(spark, d)
    av = pk.absence_summary(D.absences(spark, d)).select("match_id", "team_id", "absent", "key_name")
    h = av.selectExpr("match_id", "team_id AS home_team_id", "absent AS h_absent", "key_name AS h_key_name")
    a = av.selectExpr("match_id", "team_id AS away_team_id", "absent AS a_absent")
    j = m.join(h, ["match_id", "home_team_id"], "left").join(a, ["match_id", "away_team_id"], "left")
    return j.selectExpr("match_id", "coalesce(h_absent, 0) AS h_absent", "coalesce(a_absent, 0) AS a_absent", "h_key_name")


@query("f34_notifications", sql("coup", """
SELECT coupon_id, CASE WHEN hit THEN '✅ Kupon TUTTU — ' ELSE '❌ Kupon yatti — ' END || coalesce(printf('%.2fx', combined_odds), '—') AS title,
  num_legs || CASE WHEN hit THEN ' bacaklı kupon kazandı. İstatistiklere bak.' ELSE ' bacaklı kupon kaybetti.' END AS body FROM coup WHERE hit IS NOT NULL"""))
def f34_notifications(spark, d):
    return co.notifications(coupons(spark, d)).select("coupon_id", "title", "body")
