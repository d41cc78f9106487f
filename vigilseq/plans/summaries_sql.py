"""SQL of the queries over merged summaries and live streams."""

from __future__ import annotations

from vigilseq.plans.catalog import PERCENTS
from vigilseq.plans.oracle import ALL_WEEK, DAY, FINE, SQL, TOPK, TP, WEEK, put
from vigilseq.plans.summaries import FIVE, FREQUENT


def quantile_rows(source: str, by: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"SELECT {by}, unnest([{listed}]) AS quantile, n, true AS within FROM (SELECT {by}, count(*) AS n FROM {source} GROUP BY 1) AS g"


put("e17_sketch_percentiles", "label:i quantile:s n:i within:i", quantile_rows("(SELECT * FROM sc WHERE loss IS NOT NULL)", "label", [f"p{p}" for p in PERCENTS]), ALL_WEEK)
put(
    "e23_sketch_profile",
    "label:i quantile:s n:i within:i",
    quantile_rows("(SELECT session_id, max(label) AS label FROM ev GROUP BY 1)", "label", list(FIVE)),
    WEEK,
)
put("l15_sketch_five_number", "category:s quantile:s n:i within:i", quantile_rows(f"(SELECT * FROM det WHERE {TP} AND lead_min IS NOT NULL)", "category", list(FIVE)), TOPK)
put(
    "v4_sketch_overlap",
    "normal_only:i anomaly_only:i shared:i",
    """SELECT count(*) FILTER (n > 0 AND a = 0) AS normal_only, count(*) FILTER (n = 0 AND a > 0) AS anomaly_only, count(*) FILTER (n > 0 AND a > 0) AS shared
       FROM (SELECT event, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 1) AS a FROM ev WHERE event IS NOT NULL GROUP BY 1) AS x""",
    WEEK,
)
put(
    "v6_sketch_diversity",
    "dataset:s n_distinct:i",
    f"""SELECT 'day' AS dataset, count(DISTINCT event) AS n_distinct FROM ev UNION ALL
        SELECT 'fine', count(DISTINCT event_type || ':' || code) FROM coded UNION ALL
        SELECT 'orders', count(DISTINCT o_orderstatus || ':' || o_orderpriority) FROM orders""",
    DAY,
)
put(
    "e24_sketch_profile",
    "n_sessions:i within:i n_templates:i",
    "SELECT count(DISTINCT session_id) AS n_sessions, true AS within, count(DISTINCT event) AS n_templates FROM ev",
    DAY,
)
put(
    "v5_frequent_summary",
    "event:s lower:i upper:i floor:i",
    """SELECT event, lower, lower + total - own AS upper, total AS floor FROM (
         SELECT event, sum(cnt) AS lower, sum(floor) AS own FROM kept GROUP BY 1) AS a
       CROSS JOIN (SELECT sum(floor) AS total FROM (SELECT DISTINCT week, floor FROM kept) AS d) AS t""",
    f"""{FINE}, counted AS (SELECT epoch_us(ts) // 604800000000 AS week, event, count(*) AS cnt FROM ev GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY cnt DESC, event) AS rank FROM counted),
        floors AS (SELECT week, coalesce(max(cnt) FILTER (rank = {FREQUENT + 1}), 0) AS floor FROM ranked GROUP BY 1),
        kept AS (SELECT week, event, cnt, floor FROM ranked JOIN floors USING (week) WHERE rank <= {FREQUENT})""",
)

# Once the streams have ended they equal the reports on the whole log.
SQL["g16_stream_gap_sessions"] = SQL["g16_gap_sessions"]
SQL["e26_stream_timeline"] = SQL["e26_category_timeline"]
SQL["n12_reconciled_alerts"] = SQL["n12_stream_first_alert"]
