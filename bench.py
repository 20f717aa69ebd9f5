"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lapsewise.operators import ranking
from lapsewise.plans.catalogue import QUERIES
from lapsewise.session import local_session

HEADLINE = (
    "lapse_report",
    "d3_violation_counts",
    "d4_fk_check",
    "d8_facts",
    "a1_by_period",
    "a2_cohorts",
    "a3_rollup_report",
    "a4_concentration",
    "f10_running_spend",
    "f15_panel",
    "f16_feature_table",
    "f9_peer",
    "l1_churn_label",
    "r5_risk_rank",
    "g1_rfm5",
    "g5_profile",
    "g6_migration",
    "c5_budget",
    "c7_campaign_list",
    "m6_auc",
    "m7_metrics",
    "m8_lift",
    "p1_predictions",
    "p2_lookup",
    "p4_activity_stream",
    "u1_global_rank",
)
# Timed once more as on a cluster: rankings over ranges at any size.
RANGED = ("lapse_report", "r5_risk_rank", "f9_peer", "g5_profile", "c7_campaign_list", "m6_auc")
# The question of the baseline: features, label, quintiles, segment and rule risk, nothing else.
SLICE = """
WITH p AS (SELECT o_custkey AS customer_id, o_orderdate AS ts, cast(o_totalprice AS decimal(18,2)) AS amount FROM orders),
base AS (SELECT customer_id, datediff(date'2001-02-01', max(ts)) AS recency, count(*) AS frequency, sum(amount) AS monetary
  FROM p WHERE ts < date'2001-02-01' GROUP BY customer_id),
later AS (SELECT DISTINCT customer_id FROM p WHERE ts >= date'2001-02-01' AND ts < date'2001-07-31'),
quint AS (SELECT b.*, CASE WHEN l.customer_id IS NULL THEN 1 ELSE 0 END AS churned,
  ntile(5) OVER (ORDER BY recency DESC, b.customer_id) AS r5, ntile(5) OVER (ORDER BY frequency, b.customer_id) AS f5,
  ntile(5) OVER (ORDER BY monetary, b.customer_id) AS m5
  FROM base b LEFT JOIN later l ON b.customer_id = l.customer_id)
SELECT *, CASE WHEN r5 >= 4 AND f5 >= 4 THEN 'champions' WHEN r5 >= 4 AND f5 <= 2 THEN 'new'
  WHEN r5 <= 2 AND f5 >= 4 THEN 'at_risk' WHEN r5 <= 2 AND f5 <= 2 THEN 'hibernating' ELSE 'regular' END AS segment,
  50 * (5 - r5) / 4 + 30 * (5 - f5) / 4 + 20 * (5 - m5) / 4 AS risk FROM quint
"""


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    # The first query of a session pays for class loading.
    QUERIES["lapse_report"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.read.parquet(f"{folder}/orders.parquet").createOrReplaceTempView("orders")
    extra = {}
    for _ in range(2):
        start = time.perf_counter()
        spark.sql(SLICE).write.format("noop").mode("overwrite").save()
        extra["baseline_slice"] = round(time.perf_counter() - start, 3)
    ranking.SINGLE_TASK_ROWS = 0
    for name in RANGED:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        extra[f"{name}_ranged"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "extra": extra,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
