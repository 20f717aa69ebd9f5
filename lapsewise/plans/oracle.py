"""The same results in ANSI SQL, for DuckDB on the same tables.

Written from the definitions and not from the Spark code: windows over all rows, range joins and
correlated EXISTS are fine here and are what the Spark side avoids.
"""

from __future__ import annotations

from lapsewise.operators.sketches import rank_error
from lapsewise.plans.churn import CAMPAIGNS, DAY, HORIZON, SNAPSHOTS, WISHES

T = f"TIMESTAMP '{DAY}'"
T_END = f"({T} + INTERVAL {HORIZON} DAY)"
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def with_(*ctes: str) -> str:
    seen = list(dict.fromkeys(ctes))
    return "WITH " + ",\n".join(seen) + "\n"


PURCHASES = """purchases AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders)"""
CUT = f"cut AS (SELECT * FROM purchases WHERE order_ts < {T})"
RFM = f"""rfm AS (
  SELECT customer_id,
         date_diff('day', max(order_ts), {T}) AS recency,
         count(*) AS frequency,
         sum(amount) AS monetary,
         CAST(sum(amount) AS DOUBLE) / count(*) AS mean_order,
         date_diff('day', min(order_ts), {T}) AS tenure,
         CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= {T} - INTERVAL 365 DAY), 0)
              AS DECIMAL(18,2)) AS spend_365
  FROM cut GROUP BY customer_id)"""
LABEL = f"""label AS (
  SELECT DISTINCT c.customer_id,
         CASE WHEN EXISTS (SELECT 1 FROM purchases p WHERE p.customer_id = c.customer_id
                           AND p.order_ts >= {T} AND p.order_ts < {T_END})
              THEN 0 ELSE 1 END AS churned
  FROM cut c)"""
PEOPLE = """people AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS market_segment, n_name AS nation, r_name AS region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


def quintiles(source: str, name: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (
  SELECT *,
    ntile(5) OVER ({part}ORDER BY recency DESC, customer_id) AS r5,
    ntile(5) OVER ({part}ORDER BY frequency, customer_id) AS f5,
    ntile(5) OVER ({part}ORDER BY monetary, customer_id) AS m5
  FROM {source})"""


SEGMENT = """CASE WHEN r5 >= 4 AND f5 >= 4 THEN 'champions' WHEN r5 >= 4 AND f5 <= 2 THEN 'new'
       WHEN r5 <= 2 AND f5 >= 4 THEN 'at_risk' WHEN r5 <= 2 AND f5 <= 2 THEN 'hibernating'
       ELSE 'regular' END"""
RISK = "CAST(50 * (5 - r5) + 30 * (5 - f5) + 20 * (5 - m5) AS DOUBLE) / 4"
BAND = """CASE WHEN risk < 25 THEN 'low' WHEN risk < 50 THEN 'medium' WHEN risk < 75 THEN 'high'
       ELSE 'critical' END"""
POP = """pop AS (SELECT * FROM rfm JOIN people USING (customer_id) JOIN label USING (customer_id))"""
SCORED = f"""scored AS (
  SELECT *, {BAND} AS band,
    round(CAST(risk AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2)) * spend_365, 2) AS value_at_risk
  FROM (SELECT *, {SEGMENT} AS segment, {RISK} AS risk FROM quint))"""
BASE = [PURCHASES, CUT, RFM]
FULL = [*BASE, LABEL, PEOPLE, POP, quintiles("pop", "quint"), SCORED]
RULE = [*BASE, quintiles("rfm", "quint")]
RULE_SCORES = [*FULL, "rule_scores AS (SELECT *, risk / 100 AS probability FROM scored)"]


def bucket(key: str, salt: str) -> str:
    return f"CAST(concat('0x', substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


SKETCH_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Prepared column -> its source.
PREPARED = {"recency": "recency", "monetary": "spent", "mean_gap": "mean_gap", "recency_to_gap": "recency_to_gap"}
SPLIT = f"CASE WHEN {bucket('customer_id', 'split')} < 70 THEN 'train' ELSE 'test' END"


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


GAPS = f"""steps AS (
  SELECT customer_id, order_ts,
         date_diff('day', lag(order_ts) OVER (PARTITION BY customer_id ORDER BY order_ts, order_id),
                   order_ts) AS gap
  FROM cut),
gaps AS (
  SELECT customer_id, avg(gap) AS mean_gap, stddev_samp(gap) AS sd_gap, CAST(max(gap) AS DOUBLE) AS max_gap,
         date_diff('day', max(order_ts), {T}) / nullif(avg(gap), 0) AS recency_to_gap
  FROM steps GROUP BY customer_id)"""
TRAILING = (
    "trailing_sums AS (SELECT customer_id, "
    + ", ".join(
        f"count(*) FILTER (WHERE order_ts >= {T} - INTERVAL {n} DAY) AS orders_{n}, "
        f"CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= {T} - INTERVAL {n} DAY), 0) AS DOUBLE) AS spend_{n}"
        for n in (30, 90, 180, 365)
    )
    + " FROM cut GROUP BY customer_id)"
)
TREND = f"""trend AS (
  SELECT customer_id,
    CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= {T} - INTERVAL 180 DAY), 0) AS DOUBLE)
      / CAST(nullif(sum(amount) FILTER (WHERE order_ts >= {T} - INTERVAL 360 DAY
                                        AND order_ts < {T} - INTERVAL 180 DAY), 0) AS DOUBLE) AS spend_trend,
    CASE WHEN count(DISTINCT order_ts) > 1
         THEN round(regr_slope(CAST(amount AS DOUBLE), -date_diff('day', order_ts, {T})), 7) END AS spend_slope
  FROM cut GROUP BY customer_id)"""
BOUGHT = """bought AS (
  SELECT customer_id, l_partkey, p_type, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         CAST(l_discount AS DECIMAL(6,4)) AS discount, l_returnflag
  FROM lineitem JOIN cut ON l_orderkey = order_id LEFT JOIN part ON l_partkey = p_partkey)"""
BASKET = """basket AS (
  SELECT customer_id, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(quantity) AS DOUBLE) AS quantity,
         CAST(count(DISTINCT l_partkey) AS DOUBLE) AS distinct_parts,
         CAST(sum(discount) AS DOUBLE) / count(*) AS mean_discount
  FROM bought GROUP BY customer_id)"""
MIX = f"""typed AS (SELECT customer_id, p_type, CAST(sum(quantity) AS DOUBLE) AS q FROM bought GROUP BY 1, 2),
shares AS (SELECT *, q / sum(q) OVER (PARTITION BY customer_id) AS s FROM typed),
mix AS (
  SELECT customer_id,
    {", ".join(f"coalesce(max(s) FILTER (WHERE p_type = '{t}'), 0) AS share_{t.lower()}" for t in TYPES)},
    coalesce(sum(s) FILTER (WHERE p_type IS NULL OR p_type NOT IN ({", ".join(f"'{t}'" for t in TYPES)})), 0) AS share_other,
    round(sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END), 6) AS mix_entropy,
    first(p_type ORDER BY q DESC, p_type) AS favourite_type
  FROM shares GROUP BY customer_id)"""
SNAPS = "snaps(snapshot) AS (VALUES " + ", ".join(f"(TIMESTAMP '{s}')" for s in SNAPSHOTS) + ")"
PANEL = f"""seen AS (SELECT snapshot, p.* FROM purchases p JOIN snaps ON order_ts < snapshot),
seen_gaps AS (
  SELECT *, date_diff('day', lag(order_ts) OVER (PARTITION BY snapshot, customer_id
                                                 ORDER BY order_ts, order_id), order_ts) AS gap
  FROM seen),
panel AS (
  SELECT snapshot, customer_id, date_diff('day', max(order_ts), snapshot) AS recency,
    count(*) AS frequency, sum(amount) AS monetary,
    CAST(sum(amount) AS DOUBLE) / count(*) AS mean_order,
    date_diff('day', min(order_ts), snapshot) AS tenure, avg(gap) AS mean_gap, CAST(max(gap) AS DOUBLE) AS max_gap,
    round(stddev_samp(gap), 6) AS sd_gap,
    round(date_diff('day', max(order_ts), snapshot) / nullif(avg(gap), 0), 9) AS recency_to_gap,
    CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= snapshot - INTERVAL 180 DAY), 0) AS DOUBLE)
      / CAST(nullif(sum(amount) FILTER (WHERE order_ts >= snapshot - INTERVAL 360 DAY
                                        AND order_ts < snapshot - INTERVAL 180 DAY), 0) AS DOUBLE) AS spend_trend,
    CASE WHEN count(DISTINCT order_ts) > 1
         THEN round(regr_slope(CAST(amount AS DOUBLE), -date_diff('day', order_ts, snapshot)), 7) END AS spend_slope,
    count(*) FILTER (WHERE order_ts >= snapshot - INTERVAL 180 DAY) AS orders_180,
    CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= snapshot - INTERVAL 180 DAY), 0) AS DOUBLE) AS spend_180,
    count(*) FILTER (WHERE order_ts >= snapshot - INTERVAL 365 DAY) AS orders_365,
    CAST(coalesce(sum(amount) FILTER (WHERE order_ts >= snapshot - INTERVAL 365 DAY), 0) AS DOUBLE) AS spend_365,
    CASE WHEN EXISTS (SELECT 1 FROM purchases p WHERE p.customer_id = g.customer_id
                      AND p.order_ts >= g.snapshot AND p.order_ts < g.snapshot + INTERVAL {HORIZON} DAY)
         THEN 0 ELSE 1 END AS churned
  FROM seen_gaps g GROUP BY snapshot, customer_id)"""
PANELS = [PURCHASES, SNAPS, PANEL]
HISTORY = [
    *PANELS,
    quintiles("panel", "quint", "snapshot"),
    f"""history AS (SELECT *, {BAND} AS band
    FROM (SELECT *, {SEGMENT} AS segment, {RISK} AS risk FROM quint))""",
    """latest AS (SELECT * FROM history
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY snapshot DESC) = 1)""",
]
DAY_OF = "strftime({}, '%Y-%m-%d')"
CANDIDATES = [
    *FULL,
    "candidates AS ("
    + " UNION ALL ".join(
        f"SELECT *, '{c.campaign_id}' AS campaign_id, {c.priority} AS priority, "
        f"CAST({c.unit_cost} AS DECIMAL(18,2)) AS cost FROM scored WHERE {c.rule}"
        for c in CAMPAIGNS
    )
    + ")",
]
CAPS = "caps(campaign_id, cap) AS (VALUES " + ", ".join(
    f"('{c.campaign_id}', CAST({c.cap} AS DECIMAL(18,2)))" for c in CAMPAIGNS
) + ")"


def suppressed(source: str) -> str:
    return f"""kept AS (SELECT * FROM {source} s WHERE NOT EXISTS (
    SELECT 1 FROM purchases p WHERE p.customer_id = s.customer_id
    AND p.order_ts >= {T} - INTERVAL 14 DAY AND p.order_ts < {T}))"""


def assigned(source: str) -> str:
    return f"""assigned AS (SELECT * FROM {source} QUALIFY row_number() OVER (
    PARTITION BY customer_id ORDER BY priority, value_at_risk DESC, campaign_id) = 1)"""


def short(k: int) -> str:
    return f"""short AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, region
    ORDER BY value_at_risk DESC, customer_id) AS place_in_region FROM assigned
    QUALIFY place_in_region <= {k})"""


def funded(source: str) -> str:
    return f"""{CAPS},
spending AS (SELECT *,
    row_number() OVER (PARTITION BY campaign_id ORDER BY value_at_risk DESC, customer_id) AS place,
    sum(cost) OVER (PARTITION BY campaign_id ORDER BY value_at_risk DESC, customer_id
                    ROWS UNBOUNDED PRECEDING) AS spent FROM {source}),
funded AS (SELECT * FROM spending JOIN caps USING (campaign_id) WHERE spent <= cap)"""


ARM = f"CASE WHEN {bucket('customer_id', 'holdout')} < 10 THEN 'control' ELSE 'contact' END"
CONTACTS = """contacts AS (
  SELECT customer_id, CAST(order_ts AS DATE) AS since, CAST(order_ts AS DATE) + 30 AS until FROM purchases
  UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 13 = 0)"""
CANDIDATE_COLUMNS = f"campaign_id, customer_id, priority, {dbl('cost', 'value_at_risk')}"
def matched(source: str) -> str:
    """The match by priority: each campaign in turn takes whom the ones before left."""
    steps = []
    for k, c in enumerate(sorted(CAMPAIGNS, key=lambda c: (c.priority, c.campaign_id))):
        free = " AND ".join(["true", *[f"customer_id NOT IN (SELECT customer_id FROM match{j})" for j in range(k)]])
        steps.append(f"""match{k} AS (SELECT *,
    row_number() OVER (ORDER BY value_at_risk DESC, customer_id) AS place,
    sum(cost) OVER (ORDER BY value_at_risk DESC, customer_id ROWS UNBOUNDED PRECEDING) AS spent
  FROM {source} WHERE campaign_id = '{c.campaign_id}' AND {free} QUALIFY spent <= {c.cap})""")
    return ",\n".join(steps) + ",\nmatched AS (" + " UNION ALL ".join(f"FROM match{k}" for k in range(len(steps))) + ")"


def campaign_list(list_name: str, *chosen: str) -> str:
    return with_(
        *CANDIDATES, suppressed("candidates"), *chosen, f"listed AS (FROM {list_name})",
        """parts AS (
  SELECT customer_id, 'recency' AS name, CAST(50 * (5 - r5) AS DOUBLE) / 4 AS v FROM listed
  UNION ALL SELECT customer_id, 'frequency', CAST(30 * (5 - f5) AS DOUBLE) / 4 FROM listed
  UNION ALL SELECT customer_id, 'spend', CAST(20 * (5 - m5) AS DOUBLE) / 4 FROM listed)""",
        """told AS (
  SELECT customer_id, string_agg(name || ':' || CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR), ';'
                                 ORDER BY v DESC, name) AS reason
  FROM (SELECT * FROM parts WHERE v > 0
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, name) <= 2)
  GROUP BY customer_id)""",
    ) + f"""SELECT campaign_id, customer_id, region, segment, band, risk, {dbl('value_at_risk')}, place,
  {dbl('cost', 'spent')}, {ARM} AS arm, coalesce(reason, '') AS reason
FROM listed LEFT JOIN told USING (customer_id)"""


CAMPAIGN_LIST = campaign_list("funded", assigned("kept"), funded("assigned"))
WISHED = "wished AS (SELECT *, CAST(CASE campaign_id " + " ".join(
    f"WHEN '{c}' THEN {w}" for c, w in WISHES.items()
) + " ELSE priority END AS DOUBLE) AS wish FROM candidates)"
# The best customers choose first, each the first of its wishes that can still pay for it.
CHOICE = f"""turns AS (
  SELECT customer_id, row_number() OVER (ORDER BY value_at_risk DESC, customer_id) AS turn,
    list(campaign_id ORDER BY wish, campaign_id) AS names, list(cost ORDER BY wish, campaign_id) AS costs
  FROM wished GROUP BY customer_id, value_at_risk),
steps AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS took, map_from_entries(list((campaign_id, cap))) AS purse FROM caps
  UNION ALL
  SELECT t.turn, t.names[pick], CASE WHEN pick IS NULL THEN purse
    ELSE map_from_entries(list_transform(map_entries(purse), lambda e: (e.key,
      CASE WHEN e.key = t.names[pick] THEN CAST(e.value - t.costs[pick] AS DECIMAL(18,2)) ELSE e.value END))) END
  FROM (SELECT s.purse, t.*, list_position(list_transform(t.names,
          lambda n, i: s.purse[n] >= t.costs[i]), true) AS pick
        FROM steps s JOIN turns t ON t.turn = s.turn + 1) t)"""


def purchase_rows(source: str, where: str = "") -> str:
    return (
        f"SELECT customer_id, order_id, {DAY_OF.format('order_ts')} AS order_day, {dbl('amount')} "
        f"FROM {source} {where}"
    )


KNOWN = "(SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events))"
VIOLATIONS = """violations AS (
  SELECT 'orders' AS "table", 'amount_in_range' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders
    WHERE NOT coalesce(o_totalprice BETWEEN 1000 AND 450000, false)
  UNION ALL SELECT 'orders', 'known_status', CAST(o_orderkey AS VARCHAR) FROM orders
    WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)
  UNION ALL SELECT 'orders', 'urgent_is_closed', CAST(o_orderkey AS VARCHAR) FROM orders
    WHERE NOT coalesce(o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F', false))"""
FACTS = """facts AS (
  SELECT order_id, customer_id, order_ts, amount, lines, quantity, market_segment, nation, region
  FROM purchases JOIN people USING (customer_id)
  LEFT JOIN (SELECT l_orderkey AS order_id, count(*) AS lines, sum(l_quantity) AS quantity
             FROM lineitem GROUP BY 1) USING (order_id))"""
SPLIT_OF = "side AS (SELECT *, " + SPLIT + " AS split FROM {})"
CONTRIBUTIONS = [
    *BASE,
    SPLIT_OF.format("rfm"),
    """means AS (SELECT avg(recency) r, avg(frequency) f, avg(CAST(monetary AS DOUBLE)) m, avg(tenure) t
    FROM side WHERE split = 'train')""",
    """contrib AS (
  SELECT customer_id, 'recency' AS feature, 0.004::DOUBLE * (recency - r) AS contribution FROM rfm, means
  UNION ALL SELECT customer_id, 'frequency', -0.08::DOUBLE * (frequency - f) FROM rfm, means
  UNION ALL SELECT customer_id, 'monetary', -0.0000005::DOUBLE * (CAST(monetary AS DOUBLE) - m) FROM rfm, means
  UNION ALL SELECT customer_id, 'tenure', 0.0002::DOUBLE * (tenure - t) FROM rfm, means)""",
]


# Isotonic fit by its max-min form: the greatest over starts of the least mean over ends.
CALIBRATED = [
    *RULE_SCORES,
    """cells AS (SELECT probability AS x, sum(churned) AS y, count(*) AS w FROM rule_scores GROUP BY 1),
blocks AS (
  SELECT i.x, a.x AS start, min(CAST(m.y AS DOUBLE) / m.w) AS least
  FROM cells i JOIN cells a ON a.x <= i.x
  JOIN (SELECT s.x AS sx, e.x AS ex, sum(c.y) AS y, sum(c.w) AS w
        FROM cells s JOIN cells e ON e.x >= s.x JOIN cells c ON c.x BETWEEN s.x AND e.x
        GROUP BY 1, 2) m ON m.sx = a.x AND m.ex >= i.x
  GROUP BY 1, 2),
fitted AS (SELECT x, max(least) AS calibrated FROM blocks GROUP BY 1)""",
]


def auc_sql(group: str = "") -> str:
    lead = f"{group}, " if group else ""
    over = f"PARTITION BY {group} " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return with_(
        *RULE_SCORES,
        f"""ranked AS (SELECT *,
  rank() OVER ({over}ORDER BY probability)
  + (count(*) OVER (PARTITION BY {lead}probability) - 1) / CAST(2 AS DOUBLE) AS mean_rank
  FROM rule_scores)""",
    ) + f"""SELECT {lead}sum(churned)::BIGINT AS positives, (count(*) - sum(churned))::BIGINT AS negatives,
  round((sum(CASE WHEN churned = 1 THEN mean_rank END) - sum(churned) * (sum(churned) + 1) / CAST(2 AS DOUBLE))
        / (CAST(sum(churned) AS DOUBLE) * (count(*) - sum(churned))), 9) AS auc
FROM ranked {by}"""


FEATURE_COLUMNS = ", ".join(
    [
        "customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, mean_order, tenure",
        "mean_gap, round(sd_gap, 6) AS sd_gap, max_gap, round(recency_to_gap, 9) AS recency_to_gap",
        *[f"orders_{n}, trailing_sums.spend_{n} AS spend_{n}" for n in (30, 90, 180, 365)],
        "spend_trend, spend_slope, lines, quantity, distinct_parts, mean_discount",
        *[f"share_{t.lower()}" for t in (*TYPES, "other")],
        "mix_entropy, favourite_type, market_segment, nation, region",
    ]
)


def area(score: str) -> str:
    """Area under the ROC curve of ``swapped``: pairs won, ties as half."""
    return f"""(SELECT sum(CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5 ELSE 0.0 END) / count(*)
    FROM swapped p JOIN swapped n ON p.churned = 1 AND n.churned = 0)"""


CELLS = with_(*FULL, SPLIT_OF.format("scored"), """rates AS (
  SELECT region, CAST(avg(churned) AS DOUBLE) AS rate FROM side WHERE split = 'train' GROUP BY region)""",
    "celled AS (SELECT side.*, rate FROM side JOIN rates USING (region))").rstrip("\n")
# A search's folds and rungs come from hashes; a customer's score is the rate of its cell in the other folds.
SEARCH = with_(
    *FULL, SPLIT_OF.format("scored"),
    f"""drawn AS (SELECT *, {bucket("customer_id", "search:fold")} % 3 AS fold, {bucket("customer_id", "search:rung")} AS share
  FROM side WHERE split = 'train')""",
    """rungs(rung, percent) AS (VALUES (0, 60), (1, 100))""",
    """cells AS (""" + " UNION ALL ".join(
        f"SELECT rung, '{name}' AS candidate, fold, customer_id, churned, {cell} AS cell FROM drawn JOIN rungs ON share < percent"
        for name, cell in (("market", "market_segment"), ("region", "region"), ("region_trees", "region"))
    ) + ")",
    """sums AS (SELECT rung, candidate, cell, fold, sum(churned) AS ones, count(*) AS n FROM cells GROUP BY ALL)""",
    """graded AS (SELECT c.rung, c.candidate, c.fold, c.customer_id, c.churned,
    CAST(sum(s.ones) AS DOUBLE) / sum(s.n) AS p
  FROM cells c JOIN sums s ON s.rung = c.rung AND s.candidate = c.candidate AND s.cell = c.cell AND s.fold <> c.fold GROUP BY ALL)""",
    """areas AS (SELECT p.rung, p.candidate, p.fold,
    sum(CASE WHEN round(p.p, 6) > round(n.p, 6) THEN 1.0 WHEN round(p.p, 6) = round(n.p, 6) THEN 0.5 ELSE 0.0 END) / count(*) AS auc
  FROM graded p JOIN graded n ON n.rung = p.rung AND n.candidate = p.candidate AND n.fold = p.fold
  WHERE p.churned = 1 AND n.churned = 0 GROUP BY ALL)""",
    """means AS (SELECT rung, candidate, avg(auc) AS mean FROM areas GROUP BY ALL)""",
    """first AS (SELECT candidate FROM means WHERE rung = 0 ORDER BY mean DESC, candidate LIMIT 2)""",
    """last AS (SELECT candidate FROM means WHERE rung = 1 AND candidate IN (FROM first) ORDER BY mean DESC, candidate LIMIT 1)""",
) + """SELECT rung, candidate, fold, (SELECT count(*) FROM graded g WHERE g.rung = a.rung AND g.candidate = a.candidate AND g.fold = a.fold) AS rows,
  round(auc, 9) AS auc, CAST(candidate IN (FROM first) AND (rung = 0 OR candidate IN (FROM last)) AS BIGINT) AS kept
FROM areas a WHERE rung = 0 OR candidate IN (FROM first)"""


ORACLE: dict[str, str] = {
    "d1_load_parquet": "SELECT * FROM customer",
    "d1_load_csv": "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate), false AS corrupt FROM orders",
    "d1_load_json": "SELECT *, false AS corrupt FROM part",
    "d2_conform": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  strftime(o_orderdate, '%Y-%m-%d') AS order_day,
  CAST(TRY_CAST(o_totalprice AS DECIMAL(7,2)) AS DOUBLE) AS amount,
  CASE WHEN o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL
       THEN 'amount' ELSE '' END AS bad_fields FROM orders""",
    "d3_validate": with_(VIOLATIONS) + "SELECT * FROM violations",
    "d3_violation_counts": with_(VIOLATIONS)
    + 'SELECT "table", rule, count(*) AS violations FROM violations GROUP BY 1, 2',
    "d3_json_rules": """WITH told AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 4)
    WHEN event_id % 20 = 1 THEN '{"parts": [{"id": 7}], "tag": "c", ' || substr(props, 2) ELSE props END AS props FROM events),
docs AS (SELECT event_id, props, CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS doc FROM told),
found AS (SELECT event_id, props, doc, TRY_CAST(json_extract_string(doc, '$.k') AS INTEGER) AS k,
    json_extract_string(doc, '$.tag') AS tag, TRY_CAST(json_extract_string(doc, '$.parts[0].id') AS INTEGER) AS part FROM docs)
SELECT 'events' AS "table", rule, CAST(event_id AS VARCHAR) AS key FROM (
  SELECT event_id, 'not_json' AS rule FROM found WHERE props IS NOT NULL AND doc IS NULL
  UNION ALL SELECT event_id, 'k_in_range' FROM found WHERE (props IS NULL OR doc IS NOT NULL) AND NOT coalesce(k BETWEEN 0 AND 89, false)
  UNION ALL SELECT event_id, 'k_not_of_seven' FROM found WHERE (props IS NULL OR doc IS NOT NULL) AND NOT coalesce(k % 7 <> 3, false)
  UNION ALL SELECT event_id, 'tag_is_known' FROM found WHERE tag IS NOT NULL AND tag NOT IN ('a', 'b')
  UNION ALL SELECT event_id, 'parts_are_there' FROM found WHERE (props IS NULL OR doc IS NOT NULL) AND part IS NULL)""",
    "d4_fk_check": """SELECT o_custkey AS missing_key, count(*) AS "rows" FROM orders
  WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""",
    "d5_missing_drop": with_(PURCHASES) + purchase_rows("purchases", f"WHERE customer_id IN {KNOWN}"),
    "d5_missing_quarantine": with_(PURCHASES)
    + purchase_rows("purchases", f"WHERE customer_id NOT IN {KNOWN}"),
    "d5_missing_placeholder": f"""SELECT c_custkey AS customer_id, CAST(c_nationkey AS DOUBLE) AS nation_id,
  c_mktsegment AS market_segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance,
  0 AS placeholder FROM customer WHERE c_custkey IN {KNOWN}
  UNION ALL SELECT DISTINCT o_custkey, NULL, NULL, NULL, 1 FROM orders WHERE o_custkey NOT IN {KNOWN}""",
    "d6_key_check": """SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem
  GROUP BY 1, 2 HAVING count(*) > 1""",
    "d7_save": with_(PURCHASES) + """SELECT customer_id, order_id, strftime(order_ts, '%Y-%m-%d') AS order_day,
  CAST(amount AS DOUBLE) AS amount, year(order_ts) AS order_year FROM purchases""",
    "d8_facts": with_(PURCHASES, PEOPLE, FACTS) + """SELECT order_id, customer_id,
  strftime(order_ts, '%Y-%m-%d') AS order_day, CAST(amount AS DOUBLE) AS amount, CAST(lines AS DOUBLE) AS lines, quantity,
  market_segment, nation, region FROM facts""",
    "a1_by_period": with_(PURCHASES, """per AS (
  SELECT date_trunc('month', order_ts) AS m, count(*) AS orders, count(DISTINCT customer_id) AS customers,
         sum(amount) AS revenue FROM purchases GROUP BY 1)""") + """
SELECT strftime(m, '%Y-%m-%d') AS period, orders, customers, CAST(revenue AS DOUBLE) AS revenue,
  CAST(revenue - lag(revenue) OVER (ORDER BY m) AS DOUBLE)
    / CAST(lag(revenue) OVER (ORDER BY m) AS DOUBLE) AS growth FROM per""",
    "a2_cohorts": with_(PURCHASES, """firsts AS (
  SELECT customer_id, date_trunc('month', min(order_ts)) AS cohort FROM purchases GROUP BY 1),
aged AS (SELECT cohort, date_diff('month', cohort, date_trunc('month', order_ts)) AS age,
         count(DISTINCT customer_id) AS customers
  FROM purchases JOIN firsts USING (customer_id) GROUP BY 1, 2)""") + """
SELECT strftime(cohort, '%Y-%m-%d') AS cohort, age, customers,
  CAST(customers AS DOUBLE) / first_value(customers) OVER (PARTITION BY cohort ORDER BY age) AS retention
FROM aged""",
    "a3_rollup_report": with_(*BASE, LABEL, PEOPLE, POP) + """
SELECT region, nation, market_segment,
  CAST(grouping(region, nation, market_segment) AS BIGINT) AS level, count(*) AS customers,
  CAST(sum(monetary) AS DOUBLE) AS revenue, CAST(sum(churned) AS DOUBLE) / count(*) AS churn_rate
FROM pop GROUP BY ROLLUP (region, nation, market_segment)""",
    "a4_concentration": with_(*BASE, """tiled AS (
  SELECT monetary, ntile(10) OVER (ORDER BY monetary DESC, customer_id) AS decile FROM rfm),
held AS (SELECT decile, count(*) AS customers, sum(monetary) AS held FROM tiled GROUP BY 1)""") + """
SELECT decile, customers, CAST(held AS DOUBLE) AS held,
  CAST(held AS DOUBLE) / CAST(sum(held) OVER () AS DOUBLE) AS share,
  CAST(sum(held) OVER (ORDER BY decile) AS DOUBLE) / CAST(sum(held) OVER () AS DOUBLE) AS cumulative_share
FROM held""",
    "f1_as_of": with_(PURCHASES, CUT) + purchase_rows("cut"),
    "f2_rfm": with_(*BASE)
    + "SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, mean_order, tenure FROM rfm",
    "f3_gaps": with_(PURCHASES, CUT, GAPS) + """SELECT customer_id, mean_gap, round(sd_gap, 6) AS sd_gap,
  max_gap, round(recency_to_gap, 9) AS recency_to_gap FROM gaps""",
    "f4_trailing": with_(PURCHASES, CUT, TRAILING) + "SELECT * FROM trailing_sums",
    "f5_trend": with_(PURCHASES, CUT, TREND) + "SELECT * FROM trend",
    "f6_basket": with_(PURCHASES, CUT, BOUGHT, BASKET) + "SELECT * FROM basket",
    "f7_mix": with_(PURCHASES, CUT, BOUGHT, MIX) + "SELECT * FROM mix",
    "f8_returns": with_(PURCHASES, CUT, BOUGHT) + """SELECT customer_id,
  CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS return_share
FROM bought GROUP BY 1""",
    "f9_peer": with_(*BASE, PEOPLE, """m AS (
  SELECT customer_id, nation, CAST(monetary AS DOUBLE) AS mon, CAST(recency AS DOUBLE) AS rec
  FROM rfm JOIN people USING (customer_id))""") + """
SELECT customer_id, nation,
  round((mon - avg(mon) OVER n) / nullif(stddev_pop(mon) OVER n, 0), 6) AS monetary_z,
  round((rec - avg(rec) OVER n) / nullif(stddev_pop(rec) OVER n, 0), 6) AS recency_z,
  percent_rank() OVER (PARTITION BY nation ORDER BY mon) AS monetary_pr,
  percent_rank() OVER (PARTITION BY nation ORDER BY rec) AS recency_pr
FROM m WINDOW n AS (PARTITION BY nation)""",
    "f10_running_spend": with_(PURCHASES) + """SELECT order_id, customer_id,
  CAST(sum(amount) OVER (PARTITION BY customer_id ORDER BY order_ts
    RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS spend_window FROM purchases""",
    "f11_impute": with_(PURCHASES, CUT, GAPS, SPLIT_OF.format("gaps"), """fill AS (
  SELECT avg(mean_gap) AS m, quantile_cont(sd_gap, 0.5) AS s FROM side WHERE split = 'train')""") + """
SELECT customer_id, round(coalesce(mean_gap, m), 6) AS mean_gap, round(coalesce(sd_gap, s), 6) AS sd_gap,
  CAST(coalesce(max_gap, 0) AS DOUBLE) AS max_gap,
  CAST(mean_gap IS NULL AS BIGINT) AS mean_gap_missing, CAST(sd_gap IS NULL AS BIGINT) AS sd_gap_missing,
  CAST(max_gap IS NULL AS BIGINT) AS max_gap_missing FROM side, fill""",
    "f12_winsorize": with_(*BASE, SPLIT_OF.format("rfm"), """bound AS (
  SELECT quantile_cont(CAST(monetary AS DOUBLE), 0.01) AS ml, quantile_cont(CAST(monetary AS DOUBLE), 0.99) AS mh,
         quantile_cont(CAST(recency AS DOUBLE), 0.01) AS rl, quantile_cont(CAST(recency AS DOUBLE), 0.99) AS rh
  FROM side WHERE split = 'train')""") + """
SELECT customer_id, round(least(greatest(CAST(monetary AS DOUBLE), ml), mh), 6) AS monetary,
  round(least(greatest(CAST(recency AS DOUBLE), rl), rh), 6) AS recency FROM rfm, bound""",
    "f12_sketches": with_(PURCHASES) + " UNION ALL ".join(
        f"""SELECT 'amount' AS feature, CAST({p} AS DOUBLE) AS prob, count(*) AS n, """ + ", ".join(
            f"round(quantile_cont(CAST(amount AS DOUBLE), {min(1.0, max(0.0, p + d))!r}), 6) AS {name}"
            for d, name in ((0.0, "exact"), (-rank_error(), "low"), (rank_error(), "high"))
        ) + ", 1 AS within FROM purchases"
        for p in SKETCH_PROBS
    ),
    "f13_encode": with_(
        *BASE, PEOPLE, SPLIT_OF.format("rfm JOIN people USING (customer_id)"),
        *[
            f"""seen_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i
  FROM (SELECT DISTINCT {c} FROM side WHERE split = 'train' AND {c} IS NOT NULL))"""
            for c in ("market_segment", "region")
        ],
    ) + """SELECT customer_id, market_segment,
  coalesce(a.i, (SELECT count(*) FROM seen_market_segment)) AS market_segment_index, region,
  coalesce(b.i, (SELECT count(*) FROM seen_region)) AS region_index
FROM side LEFT JOIN seen_market_segment a ON market_segment = a.v LEFT JOIN seen_region b ON region = b.v""",
    "f14_standardize": with_(*BASE, SPLIT_OF.format("rfm"), """stat AS (
  SELECT avg(recency) AS rm, stddev_samp(recency) AS rs, avg(frequency) AS fm, stddev_samp(frequency) AS fs,
         avg(CAST(monetary AS DOUBLE)) AS mm, stddev_samp(CAST(monetary AS DOUBLE)) AS ms
  FROM side WHERE split = 'train')""") + """
SELECT customer_id, round((recency - rm) / rs, 6) AS recency, round((frequency - fm) / fs, 6) AS frequency,
  round((CAST(monetary AS DOUBLE) - mm) / ms, 6) AS monetary FROM rfm, stat""",
    "f15_panel": with_(*PANELS) + """SELECT * REPLACE (strftime(snapshot, '%Y-%m-%d') AS snapshot,
  CAST(monetary AS DOUBLE) AS monetary, CAST(churned AS BIGINT) AS churned) FROM panel""",
    "f15_line_panel": with_(
        PURCHASES, SNAPS,
        """cut AS (SELECT snapshot, order_id, snapshot || ':' || p.customer_id AS customer_id,
         p.customer_id AS id FROM purchases p JOIN snaps ON order_ts < snapshot)""",
        BOUGHT, BASKET, MIX,
        "ids AS (SELECT DISTINCT customer_id, snapshot, id FROM cut)",
    ) + f"""SELECT strftime(snapshot, '%Y-%m-%d') AS snapshot, id AS customer_id, lines, quantity,
  distinct_parts, mean_discount, {", ".join(f"share_{t.lower()}" for t in (*TYPES, "other"))}, mix_entropy, favourite_type
FROM basket JOIN mix USING (customer_id) JOIN ids USING (customer_id)""",
    "f16_feature_table": with_(
        *BASE, PEOPLE, GAPS, TRAILING, TREND, BOUGHT, BASKET, MIX
    ) + f"""SELECT {FEATURE_COLUMNS} FROM rfm JOIN people USING (customer_id)
  JOIN gaps USING (customer_id) JOIN trailing_sums USING (customer_id) JOIN trend USING (customer_id)
  LEFT JOIN basket USING (customer_id) LEFT JOIN mix USING (customer_id)""",
    "l1_churn_label": with_(PURCHASES, CUT, LABEL)
    + "SELECT customer_id, CAST(churned AS BIGINT) AS churned FROM label",
    "l2_guard": with_(
        "snaps(s) AS (VALUES "
        + ", ".join(f"(TIMESTAMP '{s}')" for s in (*SNAPSHOTS, "2001-03-01"))
        + ")"
    ) + f"""SELECT strftime(s, '%Y-%m-%d') AS snapshot,
  strftime(s + INTERVAL {HORIZON} DAY, '%Y-%m-%d') AS window_end,
  strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%d') AS data_end,
  CAST(s + INTERVAL {HORIZON} DAY > (SELECT max(o_orderdate) FROM orders) AS BIGINT) AS censored FROM snaps""",
    "l3_split_by_key": with_(PURCHASES, CUT, LABEL) + f"SELECT customer_id, {SPLIT} AS split FROM label",
    "l3_split_by_time": with_(*PANELS) + f"""SELECT strftime(snapshot, '%Y-%m-%d') AS snapshot, customer_id,
  CAST(churned AS BIGINT) AS churned,
  CASE WHEN snapshot >= TIMESTAMP '{SNAPSHOTS[-1]}' THEN 'test' ELSE 'train' END AS split FROM panel""",
    "l4_class_weight": with_(PURCHASES, CUT, LABEL) + """SELECT customer_id, CAST(churned AS BIGINT) AS churned,
  CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY churned)) AS weight FROM label""",
    "lapse_report": with_(*FULL) + f"""SELECT customer_id, recency, frequency, {dbl('monetary')},
  r5, f5, m5, segment, risk, band, {dbl('value_at_risk')}, CAST(churned AS BIGINT) AS churned FROM scored""",
    "r2_rule_risk": with_(*RULE) + f"SELECT customer_id, {RISK} AS risk FROM quint",
    "r3_risk_band": with_(*RULE) + f"""SELECT {BAND} AS band, count(*) AS customers
  FROM (SELECT {RISK} AS risk FROM quint) GROUP BY 1""",
    "r4_value_at_risk": with_(*FULL) + """SELECT region, market_segment, count(*) AS customers,
  CAST(sum(value_at_risk) AS DOUBLE) AS value_at_risk FROM scored GROUP BY 1, 2""",
    "r5_risk_rank": with_(*FULL) + """SELECT customer_id,
  row_number() OVER (ORDER BY risk DESC, customer_id) AS overall_rank,
  percent_rank() OVER (ORDER BY risk) AS overall_pr,
  percent_rank() OVER (PARTITION BY region ORDER BY risk) AS region_pr FROM scored""",
    "g1_rfm5": with_(*RULE) + "SELECT customer_id, r5, f5, m5 FROM quint",
    "g2_rule_segment": with_(*RULE) + f"""SELECT segment, count(*) AS customers
  FROM (SELECT {SEGMENT} AS segment FROM quint) GROUP BY 1""",
    "g5_profile": with_(*FULL) + """SELECT segment, count(*) AS customers,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scored) AS share,
  CAST(sum(churned) AS DOUBLE) / count(*) AS churn_rate,
  CAST(sum(recency) AS DOUBLE) / count(*) AS mean_recency,
  CAST(sum(frequency) AS DOUBLE) / count(*) AS mean_frequency,
  CAST(sum(monetary) AS DOUBLE) / count(*) AS mean_monetary,
  quantile_cont(CAST(recency AS DOUBLE), 0.5) AS median_recency,
  quantile_cont(CAST(frequency AS DOUBLE), 0.5) AS median_frequency,
  round(quantile_cont(CAST(monetary AS DOUBLE), 0.5), 6) AS median_monetary FROM scored GROUP BY 1""",
    "g6_migration": with_(*HISTORY) + f"""SELECT coalesce(a.segment, 'absent') AS segment_before,
  coalesce(b.segment, 'absent') AS segment_after, count(*) AS customers
FROM (SELECT * FROM history WHERE snapshot = TIMESTAMP '{SNAPSHOTS[0]}') a
FULL JOIN (SELECT * FROM history WHERE snapshot = TIMESTAMP '{SNAPSHOTS[-1]}') b USING (customer_id)
GROUP BY 1, 2""",
    "g7_cross_tab": with_(*FULL) + """SELECT segment, band, grouping(segment)::BIGINT AS all_segment,
  grouping(band)::BIGINT AS all_band, count(*) AS customers, CAST(sum(value_at_risk) AS DOUBLE) AS value_at_risk
FROM scored GROUP BY CUBE (segment, band)""",
    "c1_eligible": with_(*CANDIDATES) + f"SELECT {CANDIDATE_COLUMNS} FROM candidates",
    "c2_suppress": with_(*CANDIDATES, suppressed("candidates")) + f"SELECT {CANDIDATE_COLUMNS} FROM kept",
    "c2_suppress_until": with_(*CANDIDATES, CONTACTS) + f"""SELECT {CANDIDATE_COLUMNS} FROM candidates
WHERE customer_id NOT IN (SELECT customer_id FROM contacts
  WHERE (since IS NULL OR since <= CAST({T} AS DATE)) AND (until IS NULL OR until >= CAST({T} AS DATE)))""",
    "c2_suppress_dated": with_(
        *CANDIDATES, CONTACTS, f"dated AS (SELECT *, CAST({T} AS DATE) + CAST(customer_id % 60 - 40 AS INTEGER) AS day FROM candidates)"
    ) + f"""SELECT {CANDIDATE_COLUMNS}, strftime(day, '%Y-%m-%d') AS day FROM dated
WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.customer_id = dated.customer_id
  AND (since IS NULL OR since <= day) AND (until IS NULL OR until >= day))""",
    "c3_assign": with_(*CANDIDATES, assigned("candidates")) + f"SELECT {CANDIDATE_COLUMNS} FROM assigned",
    "c3_match": with_(*CANDIDATES, matched("candidates"))
    + f"SELECT campaign_id, customer_id, place, {dbl('cost', 'spent')} FROM matched",
    "c3_match_wishes": "WITH RECURSIVE " + with_(*CANDIDATES, CAPS, WISHED, CHOICE).removeprefix("WITH ")
    + f"""SELECT campaign_id, customer_id, row_number() OVER ranked AS place, {dbl('cost')},
  CAST(sum(cost) OVER ranked AS DOUBLE) AS spent
FROM steps JOIN turns USING (turn) JOIN candidates USING (customer_id) WHERE campaign_id = took
WINDOW ranked AS (PARTITION BY campaign_id ORDER BY value_at_risk DESC, customer_id ROWS UNBOUNDED PRECEDING)""",
    "c3_blocking_pairs": with_(*CANDIDATES, assigned("candidates"), funded("assigned"), matched("candidates"),
        """lists AS (SELECT 'first_offers' AS list, customer_id, campaign_id, priority, value_at_risk, cost FROM funded
  UNION ALL SELECT 'matched', customer_id, campaign_id, priority, value_at_risk, cost FROM matched)""",
        """names AS (SELECT DISTINCT list FROM lists)""",
        """pairs AS (
  SELECT n.list, c.campaign_id, c.customer_id, c.value_at_risk, c.cost FROM candidates c CROSS JOIN names n
    LEFT JOIN lists l ON l.list = n.list AND l.customer_id = c.customer_id
  WHERE l.customer_id IS NULL OR (c.priority, c.campaign_id) < (l.priority, l.campaign_id))""",
        """blocking AS (
  SELECT p.list, p.campaign_id FROM pairs p JOIN caps USING (campaign_id)
  WHERE p.cost + coalesce((SELECT sum(l.cost) FROM lists l WHERE l.list = p.list AND l.campaign_id = p.campaign_id
    AND (l.value_at_risk > p.value_at_risk OR (l.value_at_risk = p.value_at_risk AND l.customer_id < p.customer_id))), 0) <= cap)""")
    + """SELECT n.list, c.campaign_id, (SELECT count(*) FROM blocking b WHERE b.list = n.list AND b.campaign_id = c.campaign_id) AS pairs
FROM names n CROSS JOIN caps c""",
    "c4_top_k": with_(*CANDIDATES, assigned("candidates"), short(10))
    + "SELECT campaign_id, region, customer_id, place_in_region AS place FROM short",
    "c5_budget": with_(*CANDIDATES, assigned("candidates"), funded("assigned"))
    + f"SELECT campaign_id, customer_id, place, {dbl('spent')} FROM funded",
    "c6_holdout": with_(*CANDIDATES, assigned("candidates"))
    + f"SELECT campaign_id, customer_id, {ARM} AS arm FROM assigned",
    "c7_campaign_list": CAMPAIGN_LIST,
    "c7_matched_list": campaign_list("matched", matched("kept")),
    "c8_overlap": with_(
        *CANDIDATES,
        "a AS (SELECT customer_id FROM candidates WHERE campaign_id = 'rescue_value')",
        "b AS (SELECT customer_id FROM candidates WHERE campaign_id = 'win_back')",
    ) + """SELECT customer_id, CASE WHEN b.customer_id IS NULL THEN 'only_a'
  WHEN a.customer_id IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM a FULL JOIN b USING (customer_id)""",
    "c8_overlaps": with_(
        *CANDIDATES, f"names AS (SELECT unnest({sorted(c.campaign_id for c in CAMPAIGNS)}) AS name)",
        "held AS (SELECT DISTINCT campaign_id, customer_id FROM candidates)",
    ) + """SELECT x.name AS a, y.name AS b,
  (SELECT count(*) FROM held p JOIN held q USING (customer_id) WHERE p.campaign_id = x.name AND q.campaign_id = y.name) AS both,
  (SELECT count(*) FROM held p WHERE p.campaign_id = x.name AND customer_id NOT IN (SELECT customer_id FROM held WHERE campaign_id = y.name)) AS only_a,
  (SELECT count(*) FROM held p WHERE p.campaign_id = y.name AND customer_id NOT IN (SELECT customer_id FROM held WHERE campaign_id = x.name)) AS only_b
FROM names x JOIN names y ON x.name < y.name""",
    "c9_export": CAMPAIGN_LIST,
    "m6_auc": auc_sql(),
    "m6_auc_by_region": auc_sql("region"),
    "m7_metrics": with_(*RULE_SCORES, """marks(threshold) AS (VALUES (0.25::DOUBLE), (0.5), (0.75)),
tally AS (SELECT threshold,
    count(*) FILTER (WHERE probability >= threshold AND churned = 1) AS tp,
    count(*) FILTER (WHERE probability >= threshold AND churned = 0) AS fp,
    count(*) FILTER (WHERE probability < threshold AND churned = 0) AS tn,
    count(*) FILTER (WHERE probability < threshold AND churned = 1) AS fn,
    round(avg(-(churned * ln(least(greatest(probability, 1e-6), 1 - 1e-6))
      + (1 - churned) * ln(1 - least(greatest(probability, 1e-6), 1 - 1e-6)))), 6) AS log_loss,
    round(avg((probability - churned) * (probability - churned)), 6) AS brier
  FROM rule_scores, marks GROUP BY 1)""") + """
SELECT threshold, tp, fp, tn, fn, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision,
  CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
  CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1, log_loss, brier FROM tally""",
    "m8_lift": with_(*RULE_SCORES, """tiled AS (
  SELECT churned, ntile(10) OVER (ORDER BY probability DESC, customer_id) AS decile FROM rule_scores),
per AS (SELECT decile, count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churners FROM tiled GROUP BY 1)""")
    + """
SELECT decile, customers, churners, CAST(churners AS DOUBLE) / customers AS churn_rate,
  round(CAST(churners AS DOUBLE) / customers
    / (CAST(sum(churners) OVER () AS DOUBLE) / sum(customers) OVER ()), 9) AS lift,
  CAST(sum(churners) OVER (ORDER BY decile) AS DOUBLE) / CAST(sum(churners) OVER () AS DOUBLE) AS gain
FROM per""",
    "m9_reliability": with_(*RULE_SCORES) + """SELECT
  CAST(least(floor(probability * 10), 9) AS BIGINT) AS bin, count(*) AS customers,
  round(avg(probability), 6) AS mean_score, round(avg(CAST(churned AS DOUBLE)), 9) AS observed
FROM rule_scores GROUP BY 1""",
    "m1_assemble": with_(*BASE) + """SELECT customer_id, CAST(recency AS DOUBLE) AS recency,
  CAST(frequency AS DOUBLE) AS frequency, CAST(monetary AS DOUBLE) AS monetary FROM rfm""",
    "m9_calibrate": with_(*CALIBRATED) + """SELECT customer_id, probability, round(calibrated, 9) AS calibrated
FROM rule_scores JOIN fitted ON x = probability""",
    "m9_crosswise": with_(
        *RULE_SCORES, f"""folded AS (SELECT *, {bucket("customer_id", "calibration")} % 5 AS fold FROM rule_scores)""",
        """cells AS (SELECT k, probability AS x, sum(churned) AS y, count(*) AS w
  FROM folded JOIN (SELECT unnest(range(5)) AS k) ON fold <> k GROUP BY ALL)""",
        """runs AS (SELECT s.k, s.x AS sx, e.x AS ex, CAST(sum(c.y) AS DOUBLE) / sum(c.w) AS rate
  FROM cells s JOIN cells e ON e.k = s.k AND e.x >= s.x JOIN cells c ON c.k = s.k AND c.x BETWEEN s.x AND e.x GROUP BY ALL)""",
        """least AS (SELECT i.k, i.x, m.sx, min(m.rate) AS rate FROM cells i JOIN runs m ON m.k = i.k AND m.sx <= i.x AND m.ex >= i.x GROUP BY ALL)""",
        """fitted AS (SELECT k, x, max(rate) AS rate FROM least GROUP BY ALL)""",
        """near AS (SELECT customer_id, probability, fold,
    (SELECT max(x) FROM fitted WHERE k = fold AND x <= probability) AS lo, (SELECT min(x) FROM fitted WHERE k = fold AND x >= probability) AS hi
  FROM folded)""",
    ) + """SELECT customer_id, probability, round(CASE WHEN lo IS NULL THEN h.rate WHEN hi IS NULL OR lo = hi THEN l.rate
  ELSE l.rate + (h.rate - l.rate) * (probability - lo) / (hi - lo) END, 9) AS calibrated
FROM near LEFT JOIN fitted l ON l.k = fold AND l.x = lo LEFT JOIN fitted h ON h.k = fold AND h.x = hi""",
    "r1_risk_score": with_(*CALIBRATED) + """SELECT customer_id, round(100 * calibrated, 2) AS risk
FROM rule_scores JOIN fitted ON x = probability""",
    "m11_linear_contributions": with_(*CONTRIBUTIONS)
    + "SELECT customer_id, feature, round(contribution, 6) AS contribution FROM contrib",
    "m13_reasons": with_(*CONTRIBUTIONS) + """SELECT customer_id,
  row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, feature) AS place, feature,
  round(contribution, 6) AS contribution FROM contrib QUALIFY place <= 2""",
    "p1_predictions": with_(*HISTORY) + """SELECT customer_id,
  strftime(snapshot, '%Y-%m-%d') AS snapshot, segment, risk, band FROM latest""",
    "p2_lookup": with_(*HISTORY) + """SELECT event_id AS request_id, user_id * 11 AS customer_id,
  strftime(snapshot, '%Y-%m-%d') AS snapshot, segment, risk, band,
  CAST(l.customer_id IS NOT NULL AS BIGINT) AS found
FROM events LEFT JOIN latest l ON l.customer_id = user_id * 11""",
    "p1_store": with_(*HISTORY) + """SELECT customer_id,
  strftime(snapshot, '%Y-%m-%d') AS snapshot, segment, risk, band FROM latest""",
    "p2_store_lookup": with_(*HISTORY) + """SELECT event_id AS request_id, user_id * 11 AS customer_id,
  strftime(snapshot, '%Y-%m-%d') AS snapshot, segment, risk, band,
  CAST(l.customer_id IS NOT NULL AS BIGINT) AS found
FROM events LEFT JOIN latest l ON l.customer_id = user_id * 11 WHERE event_id % 40 = 0""",
    "p3_score_stream": with_(*FULL) + """SELECT event_id, user_id AS customer_id, event_type, risk, band,
  CAST(s.customer_id IS NOT NULL AS BIGINT) AS known
FROM events LEFT JOIN scored s ON s.customer_id = user_id""",
    "p4_activity_stream": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS customer_id,
  count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  CAST(sum(TRY_CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value,
  count(*) FILTER (WHERE value IS NOT NULL AND TRY_CAST(value AS DECIMAL(18,2)) IS NULL) AS bad_values
FROM events GROUP BY 1, 2""",
    "m2_cells": CELLS + "SELECT customer_id, region, round(rate, 4) AS probability FROM celled WHERE split = 'test'",
    "m3_cells": CELLS + "SELECT customer_id, region, CAST(rate > 0.5 AS BIGINT) AS predicted FROM celled WHERE split = 'test'",
    "m4_search": SEARCH,
    "m5_cells": CELLS + """SELECT customer_id, round(rate, 4) AS probability, round(ln(rate / (1 - rate)), 4) AS margin,
  CAST(rate > 0.5 AS BIGINT) AS predicted FROM celled""",
    "m10_cells": CELLS + f""", tested AS (
  SELECT customer_id, churned, rate,
    row_number() OVER (ORDER BY md5('importance:donor:' || CAST(customer_id AS VARCHAR)), customer_id) AS donor,
    row_number() OVER (ORDER BY md5('importance:receiver:' || CAST(customer_id AS VARCHAR)), customer_id) AS receiver
  FROM celled WHERE split = 'test'),
swapped AS (SELECT a.churned, a.rate, b.rate AS other FROM tested a JOIN tested b ON a.receiver = b.donor)
SELECT 'region' AS feature, round({area("rate")} - {area("other")}, 9) AS auc_drop""",
    "m12_cells": CELLS + """, known AS (
  SELECT rate FROM celled WHERE split = 'train' ORDER BY md5('background:' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 32)
SELECT customer_id, 'region' AS feature, round(rate - (SELECT avg(rate) FROM known), 4) + 0.0 AS contribution
FROM celled WHERE split = 'test'
UNION ALL SELECT customer_id, 'market_segment', 0.0 FROM celled WHERE split = 'test'""",
    "m12_with_errors": CELLS + """, known AS (
  SELECT rate FROM celled WHERE split = 'train' ORDER BY md5('background:' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 32)
SELECT customer_id, 'region' AS feature, round(rate - (SELECT avg(rate) FROM known), 4) + 0.0 AS contribution,
  round((SELECT stddev_samp(rate) / sqrt(count(*)) FROM known), 4) AS error, (SELECT count(*) FROM known) AS draws
FROM celled WHERE split = 'test'
UNION ALL SELECT customer_id, 'market_segment', 0.0, 0.0, (SELECT count(*) FROM known) FROM celled WHERE split = 'test'""",
    "m14_cells": CELLS + "SELECT customer_id, round(rate, 4) AS probability FROM celled",
    "m14_prepared": with_(
        *BASE, PEOPLE, GAPS, SPLIT_OF.format("(SELECT *, CAST(monetary AS DOUBLE) AS spent FROM rfm) JOIN people USING (customer_id) JOIN gaps USING (customer_id)"),
        "train AS (SELECT * FROM side WHERE split = 'train')",
        "bound AS (SELECT " + ", ".join(
            f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS {n}_lo, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS {n}_hi"
            for n, c in PREPARED.items()
        ) + " FROM train)",
        "clipped AS (SELECT customer_id, split, market_segment, nation, " + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN least(greatest(CAST({c} AS DOUBLE), {n}_lo), {n}_hi) END AS {n}" for n, c in PREPARED.items()
        ) + " FROM side, bound)",
        "fill AS (SELECT " + ", ".join(f"avg({n}) AS fill_{n}" for n in PREPARED) + " FROM clipped WHERE split = 'train')",
        "filled AS (SELECT customer_id, split, market_segment, nation, " + ", ".join(
            f"coalesce({n}, fill_{n}) AS {n}, CAST({n} IS NULL AS BIGINT) AS {n}_missing" for n in PREPARED
        ) + " FROM clipped, fill)",
        "scale AS (SELECT " + ", ".join(f"avg({n}) AS mean_{n}, stddev_samp({n}) AS sd_{n}" for n in PREPARED) + " FROM filled WHERE split = 'train')",
        *[
            f"""seen_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i
  FROM (SELECT DISTINCT {c} FROM train WHERE {c} IS NOT NULL))"""
            for c in ("market_segment", "nation")
        ],
    ) + "SELECT customer_id, " + ", ".join(f"round(({n} - mean_{n}) / sd_{n}, 6) + 0.0 AS {n}, {n}_missing" for n in PREPARED) + """,
  coalesce(a.i, (SELECT count(*) FROM seen_market_segment)) AS market_segment_index,
  coalesce(b.i, (SELECT count(*) FROM seen_nation)) AS nation_index
FROM scale, filled LEFT JOIN seen_market_segment a ON market_segment = a.v LEFT JOIN seen_nation b ON nation = b.v""",
    "g3_regions": """WITH people AS (
  SELECT c_custkey AS customer_id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT customer_id, min(customer_id) OVER (PARTITION BY region) AS group_id, count(*) OVER (PARTITION BY region) AS customers FROM people""",
    "g3_adjusted_rand": with_(*FULL, *[
        f"""rand_{k} AS (SELECT '{a}' AS a, '{b}' AS b, sum(n) AS rows, sum(n * (n - 1) / 2) AS common,
    (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM scored GROUP BY {a})) AS l,
    (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM scored GROUP BY {b})) AS r
  FROM (SELECT count(*) AS n FROM scored GROUP BY {a}, {b}))"""
        for k, (a, b) in enumerate((("segment", "band"), ("region", "segment"), ("r5", "r5")))
    ]) + """SELECT a, b, CAST(rows AS BIGINT) AS rows, round((common - l * r / (rows * (rows - 1) / 2)) / ((l + r) / 2 - l * r / (rows * (rows - 1) / 2)), 9) AS rand
FROM (FROM rand_0 UNION ALL FROM rand_1 UNION ALL FROM rand_2)""",
    "g4_regions": """SELECT count(DISTINCT r_name) AS k, 1 AS best
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "p4_kept_activity": """WITH timed AS (SELECT *, CASE WHEN event_id % 97 <> 0 THEN ts END AS told FROM events)
SELECT strftime(date_trunc('day', told), '%Y-%m-%d') AS day, user_id AS customer_id,
  count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  CAST(sum(TRY_CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value,
  count(*) FILTER (WHERE value IS NOT NULL AND TRY_CAST(value AS DECIMAL(18,2)) IS NULL) AS bad_values
FROM timed GROUP BY 1, 2""",
    "u1_global_rank": with_(PURCHASES) + """SELECT order_id,
  row_number() OVER (ORDER BY amount DESC, order_id) AS rn,
  ntile(7) OVER (ORDER BY amount DESC, order_id) AS tile,
  CAST(sum(amount) OVER (ORDER BY amount DESC, order_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS run_amount
FROM purchases""",
    "u1_group_rank": """SELECT o_orderkey AS order_id, o_orderpriority AS priority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS rn_rows,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderpriority
    ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS run_amount
FROM orders""",
}
