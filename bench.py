"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_RUNS (timed runs per query, the
median counts), BENCH_QUERIES (comma list instead of the headline queries, or "all").
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.queries import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

# One query per pipeline and per kind of operator.
HEADLINE = [
    "cdc_clean", "cdc_latest_by_key", "cdc_transition", "cdc_route_config", "dim_maintenance", "routed_facts",
    "log_new_visitor_fix", "log_split_pages", "log_split_explode",
    "fact_comment_lookup", "fact_cart_add_delta", "fact_order_detail", "fact_cancel_detail", "fact_pay_interval",
    "fact_refund_two_lookups", "fact_refund_pay_composite",
    "enrich_snowflake", "flag_first_of_day", "flag_daily_and_new", "flag_returning_user",
    "delta_last_value", "delta_four_amounts",
    "win_keyword_count", "win_page_view", "win_home_detail_uv", "win_login", "win_register", "win_cart_uu",
    "win_payment", "win_order", "win_sku_order", "win_province_order", "win_refund_brand_user",
    "agg_distinct_ids", "gmv_by_day", "keyword_split_texts",
    "stream_tumbling", "stream_interval_join", "stream_upsert", "stream_refund_brand_user",
]


def seconds(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    shuffles = 2 * int(cpus) if cpus.isdigit() else 16
    times = {}
    with tempfile.TemporaryDirectory(prefix="millrace-bench-") as shared:
        spark = local_session(cpus, shuffles, **{"spark.checkpoint.dir": shared})
        for name in names:
            seconds(spark, name, sf_dir)  # warm-up: code generation and file cache
            times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
        spark.stop()
    print(json.dumps({
        "metric": "total time of the queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
