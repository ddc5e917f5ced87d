"""Headline benchmark: prints one JSON line with seconds per query.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores. Results go to Spark's noop sink,
so every row is computed and nothing is collected.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from touchline.plans import catalog, derive  # noqa: E402
from touchline.session import local_session  # noqa: E402

HEADLINE = [
    "m0_upcoming_value",        # flagship: positive value among upcoming selections
    "a13_full_payload",         # market expansion of every match
    "t1_top_correct_scores",    # 121-cell ranking of every match
    "w7_best_price_last_wins",  # best price per selection
    "j12_table_before_kickoff",  # as-of standings
    "f7_motivation",            # stakes from the as-of table
    "a3_form",                  # last six matches before each kickoff
    "u8_accuracy_rows",         # argmax picks and outcomes
    "a22_ev_grid_top30",        # strategy grid search
    "u1_full_fit",              # pooled fit on everything before NOW
    "u3_walk_forward_league",   # all folds of every league, out-of-sample losses
    "u5_isotonic_fit",          # calibration curves
    "u6_prediction_batch",      # nightly batch
    "f12_context_scores",       # picks with motivation, form and availability
    "t5_composed_legs",         # greedy coupons per day
    "t7_hit_variants",          # hit-probability variants per day
    "j6_live_row_to_match",     # feed rows to matches
    "st1_live_fold",            # live state fold
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    # start the JVM, one Python worker per core and the parquet reader before the clock
    derive.table(spark, d, "orders").groupBy("o_orderstatus").count().collect()
    spark.range(0, 64, 1, int(cpus)).mapInPandas(lambda it: it, "id long").count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(d.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
