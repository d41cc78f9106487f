"""The same results as plain SQL over the given tables, to check the queries against."""

from __future__ import annotations

from vigilseq.functions import numeric as num
from vigilseq.functions import text as txt
from vigilseq.operators.evaluate import COARSE_GRID
from vigilseq.operators.vocab import PAD, SEP, UNK
from vigilseq.plans import reports
from vigilseq.plans.catalog import PERCENTS, TRIALS
from vigilseq.plans.registry import LARGE

SQL: dict[str, str] = {}

_CASTS = {
    "s": "{c}::VARCHAR",
    "i": "{c}::BIGINT",
    "d": f"CASE WHEN abs({{c}}::DOUBLE) < {LARGE} THEN floor({{c}}::DOUBLE * 1e6 + 0.5) / 1e6 ELSE {{c}}::DOUBLE END",
    "t": "epoch_us({c})",
    "l": "array_to_string({c}, ' ')",
}


def put(name: str, columns: str, body: str, ctes: str = "") -> None:
    """Register ``body`` with its result columns ``name:kind`` (s text, i bigint, d double, t time, l list)."""
    cast = []
    for item in columns.split():
        column, kind = item.split(":")
        cast.append(f'{_CASTS[kind].format(c=chr(34) + column + chr(34))} AS "{column}"')
    SQL[name] = f"{'WITH ' + ctes if ctes else ''} SELECT {', '.join(cast)} FROM ({body}) AS r"


def text(value: str) -> str:
    """SQL literal of a text with any characters."""
    plain = value.replace("'", "''")
    if all(c.isprintable() for c in value):
        return f"'{plain}'"
    return "(" + " || ".join(f"chr({ord(c)})" for c in value) + ")"


# -- logs ---------------------------------------------------------------------

CODED = """coded AS (
  SELECT event_id, user_id, ts, event_type, value, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS code FROM events)"""
SYMBOL = "event_type || ':' || (code % 4)::VARCHAR"
RARE = "CASE WHEN event_type = 'error' AND code < 10 THEN 1 ELSE 0 END"

DAY = f"""{CODED}, ev AS (
  SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS session_id, ts, event_id AS tiebreak,
         {SYMBOL} AS event, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM coded)"""
WEEK = f"""{CODED}, ev AS (
  SELECT user_id::VARCHAR || '-w' || (epoch_us(ts) // 604800000000)::VARCHAR AS session_id, ts, event_id AS tiebreak,
         {SYMBOL} AS event, {RARE} AS label FROM coded)"""
USER = f"""{CODED}, ev AS (
  SELECT user_id AS session_id, ts, event_id AS tiebreak, {SYMBOL} AS event, {RARE} AS label FROM coded)"""
GAPPY = f"""{CODED}, ev AS (
  SELECT user_id AS session_id, ts, event_id AS tiebreak,
         CASE WHEN NOT value < 2 THEN {SYMBOL} END AS event, {RARE} AS label FROM coded)"""
FINE = f"""{CODED}, ev AS (
  SELECT user_id::VARCHAR || '#' || (event_id % 5)::VARCHAR AS session_id, ts, event_id AS tiebreak, event_type || ':' || code::VARCHAR AS event,
         {RARE} AS label FROM coded)"""
TALK = """ev AS (
  SELECT conv_id AS session_id, make_timestamp(turn * 1000000) AS ts, turn AS tiebreak, role AS event,
         CASE WHEN role = 'system' THEN 1 ELSE 0 END AS label FROM conversations)"""
ORDERS = """ev AS (
  SELECT o_custkey AS session_id, o_orderdate AS ts, o_orderkey AS tiebreak,
         o_orderstatus || ':' || o_orderpriority AS event,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders)"""
LINES = f"""{CODED}, lines AS (
  SELECT ts, event_id AS tiebreak, user_id, 'INFO ' || event_type || ' of blk_' || user_id || ' from /10.0.0.' || (code % 7)
         || ':50010 code ' || code AS line FROM coded)"""
POS = """p AS (
  SELECT *, row_number() OVER s - 1 AS pos, max(label) OVER g AS session_label, count(*) OVER g AS n_events,
         lag(event, 1) OVER s AS prev1, lag(event, 2) OVER s AS prev2
  FROM ev WINDOW s AS (PARTITION BY session_id ORDER BY ts, tiebreak), g AS (PARTITION BY session_id))"""
HEAD = "hd AS (SELECT session_id, substr(string_agg(event, ' ' ORDER BY pos), 1, 50) AS head FROM p GROUP BY 1)"
SUMMARY = """ses AS (
  SELECT session_id, max(label) AS label, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events,
         sum(label) AS n_error_events, arg_max(event, (ts, tiebreak)) AS last_event,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 * 60 AS duration_sec FROM ev GROUP BY session_id)"""


def mask(column: str) -> str:
    for rule in txt.MASK_RULES:
        column = f"regexp_replace({column}, '{rule}', '<*>', 'g')"
    return column


def pct(key: str, seed: str = "42") -> str:
    return f"(('0x' || substr(md5('{seed}' || {key}), 1, 8))::BIGINT % 100)"


def split(key: str, label: str, seed: str = "42") -> str:
    p = pct(key, seed)
    return f"CASE WHEN {label} = 1 THEN 'test' WHEN {p} < 80 THEN 'train' WHEN {p} < 90 THEN 'val' ELSE 'test' END"


def rules(column: str, table: list[tuple[str, str]], default: str = "Other") -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in table)
    return f"CASE {cases} ELSE '{default}' END"


# -- detectors ----------------------------------------------------------------


def scored(log: str, k: int, skip: int) -> str:
    """CTEs up to ``sc``: scored events of all splits, order 1."""
    return f"""{log}, {POS}, x AS (SELECT *, {split('session_id', 'session_label')} AS split FROM p),
    c1 AS (SELECT prev1 AS ctx, event AS next, count(*) AS cnt FROM x
           WHERE split = 'train' AND prev1 IS NOT NULL GROUP BY 1, 2),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, next) AS rank,
                  sum(cnt) OVER (PARTITION BY ctx) AS ctx_cnt FROM c1),
    c0 AS (SELECT event AS next, count(*) AS cnt FROM x WHERE split = 'train' GROUP BY 1),
    r0 AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, next) AS rank FROM c0),
    tot AS (SELECT sum(cnt) AS n, count(*) + 1 AS v FROM c0),
    k1 AS (SELECT DISTINCT ctx, ctx_cnt FROM r1),
    sc AS (SELECT x.*,
        CASE WHEN pos >= {max(1, skip)} THEN -ln((coalesce(CASE WHEN k1.ctx IS NOT NULL THEN r1.cnt ELSE r0.cnt END, 0) + 1.0)::DOUBLE
             / (coalesce(k1.ctx_cnt, tot.n)::DOUBLE + tot.v::DOUBLE)) END AS loss,
        CASE WHEN pos >= {max(1, skip)} THEN coalesce(CASE WHEN k1.ctx IS NOT NULL THEN r1.rank <= {k} ELSE r0.rank <= {k} END, false)
             END AS in_topk
      FROM x CROSS JOIN tot LEFT JOIN k1 ON x.prev1 = k1.ctx LEFT JOIN r1 ON x.prev1 = r1.ctx AND x.event = r1.next
           LEFT JOIN r0 ON x.event = r0.next)"""


def detected(source: str, alert: str) -> str:
    """CTE ``det`` from scored rows."""
    return f"""a AS (SELECT *, {alert} AS hit FROM {source}),
    d0 AS (SELECT session_id, max(label) AS label, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts,
        max(loss) AS max_loss, avg(loss) AS avg_loss, arg_max(event, pos) AS last_event,
        coalesce(max(CASE WHEN hit THEN 1 ELSE 0 END), 0) AS predicted,
        min(pos) FILTER (hit) AS alert_pos, arg_min(ts, pos) FILTER (hit) AS alert_ts,
        arg_min(event, pos) FILTER (hit) AS alert_event,
        coalesce(arg_min(loss, pos) FILTER (hit), 0.0) AS alert_loss,
        min(pos) FILTER (label = 1) AS first_error_pos, arg_min(ts, pos) FILTER (label = 1) AS first_error_ts,
        arg_min(event, pos) FILTER (label = 1) AS first_error_event FROM a GROUP BY session_id)"""


CATEGORY = rules("first_error_event", reports.CATEGORY_RULES)
TOPK = f"""{scored(DAY, reports.TOP_K, 1)}, {detected("(SELECT * FROM sc WHERE split = 'test')", 'NOT in_topk')},
    det AS (SELECT *, coalesce(alert_pos - 1, -1) AS first_anomaly_step, {CATEGORY} AS category,
        (epoch_us(first_error_ts) - epoch_us(alert_ts)) / 6e7 AS lead_min,
        (epoch_us(first_error_ts) - epoch_us(alert_ts)) / 6e7 * 60 AS lead_sec,
        first_error_pos - alert_pos AS steps_before_error FROM d0)"""
ALL_WEEK = scored(WEEK, 5, reports.SKIP)
_HIT = f"loss > {reports.THRESHOLD} AND pos >= {reports.SKIP}"
WEEK_TEST = "(SELECT * FROM sc WHERE split = 'test')"
THRESHOLD = f"""{ALL_WEEK}, {detected(WEEK_TEST, _HIT)},
    det AS (SELECT *, {CATEGORY} AS category, first_error_pos - alert_pos AS steps_before_error,
        CASE WHEN predicted = 1 THEN (epoch_us(end_ts) - epoch_us(alert_ts)) / 6e7 ELSE 0.0 END AS lead_min FROM d0)"""
TP = "label = 1 AND predicted = 1"
LOSSES = f"""{ALL_WEEK}, sl AS (SELECT session_id, max(session_label) AS label, avg(loss) AS avg_loss, max(loss) AS max_loss,
    count(loss) AS n_scored FROM sc GROUP BY session_id)"""
CONF = """cf AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
    count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM {t})"""


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def metrics(source: str) -> str:
    """Precision .. F1 from a table of confusion counts."""
    return f"""SELECT *, {div('2 * precision * recall', 'precision + recall')} AS f1 FROM (SELECT *, {div('tp', 'tp + fp')} AS precision,
        {div('tp', 'tp + fn')} AS recall, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {div('tn', 'tn + fp')} AS specificity
        FROM {source}) AS m"""


METRIC_COLUMNS = "tp:i fp:i tn:i fn:i precision:d recall:d accuracy:d specificity:d f1:d"

# -- sources ------------------------------------------------------------------

put("s1_read_events_csv", "session_id:s ts:t event:s label:i", "SELECT * FROM ev", DAY)
put(
    "s1_read_openstack",
    "session_id:i ts:t event:s label:i template:s Content:s service:s",
    """SELECT user_id AS session_id, ts, event_type || ':' || code AS event, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
              'event <*>, "kind" ' || event_type AS template, 'code ' || code AS Content, 'svc' || (user_id % 3) AS service FROM coded""",
    CODED,
)
put(
    "s1_read_bgl",
    "session_id:s pos:i ts:t event:s label:i",
    """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY date_trunc('hour', ts), tiebreak) - 1 AS pos,
              date_trunc('hour', ts)::TIMESTAMP AS ts, event, label FROM ev""",
    USER,
)
put(
    "s2_read_columns_coerce_ts",
    "session_id:s n:i n_ts:i last_ts:t",
    """SELECT session_id, count(*) AS n, count(*) FILTER (tiebreak % 10 <> 0) AS n_ts,
              max(ts) FILTER (tiebreak % 10 <> 0) AS last_ts FROM ev GROUP BY 1""",
    DAY,
)
FLAWED = f"""{DAY}, fl AS (
  SELECT *, CASE WHEN tiebreak % 13 = 0 THEN '' ELSE session_id END AS s,
    CASE WHEN tiebreak % 10 = 0 THEN 'not a time' WHEN tiebreak % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') ||
      CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END END AS t,
    CASE WHEN tiebreak % 17 = 0 THEN '2' WHEN tiebreak % 19 = 0 THEN '' WHEN tiebreak % 23 = 0 THEN 'x' ELSE label::VARCHAR END AS y,
    CASE WHEN tiebreak % 29 = 0 THEN ',more' ELSE '' END AS more FROM ev),
  checked AS (SELECT *, s || ',' || t || ',"' || event || ', ""k""' || '"' || ',' || y || more AS line,
    CASE WHEN more <> '' OR y = 'x' THEN 'malformed row' WHEN s = '' THEN 'no session' WHEN t = '' THEN 'no time'
         WHEN t = 'not a time' THEN 'unreadable time' WHEN y NOT IN ('0', '1') THEN 'unknown label' END AS reason FROM fl)"""
put(
    "s2_kept_rows",
    "session_id:s ts:t event:s label:i",
    """SELECT session_id, ts, event || ', "k"' AS event, label FROM checked WHERE reason IS NULL""",
    FLAWED,
)
put("s2_rejected_rows", "reason:s line:s n:i", "SELECT reason, line, count(*) OVER (PARTITION BY reason) AS n FROM checked WHERE reason IS NOT NULL", FLAWED)
put(
    "s3_events_from_raw",
    "session_id:s tiebreak:i event:s label:i template:s",
    f"""SELECT 'blk_' || l.user_id AS session_id, tiebreak, substr(md5(template), 1, 8) AS event, b.label, template
        FROM (SELECT *, {mask('line')} AS template FROM lines) AS l
        JOIN (SELECT user_id, max({RARE}) AS label FROM coded GROUP BY 1) AS b ON l.user_id = b.user_id""",
    LINES,
)
put(
    "s3_read_lines",
    "session_id:s pos:i ts:t event:s label:i template:s",
    f"""SELECT 'blk_' || l.user_id AS session_id, row_number() OVER (PARTITION BY l.user_id ORDER BY date_trunc('hour', ts), tiebreak) - 1 AS pos,
          date_trunc('hour', ts)::TIMESTAMP AS ts, substr(md5(template), 1, 8) AS event, b.label, template
        FROM (SELECT *, {mask('line')} AS template FROM lines) AS l
        JOIN (SELECT user_id, max({RARE}) AS label FROM coded GROUP BY 1) AS b ON l.user_id = b.user_id""",
    LINES,
)
put(
    "s3_event_dictionary",
    "session_id:s first_error_pos:i first_error_event:s first_error_event_template:s",
    f"""SELECT 'blk_' || user_id AS session_id, min(pos) AS first_error_pos, arg_min(substr(md5(template), 1, 8), pos) AS first_error_event,
          arg_min(template, pos) AS first_error_event_template
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, tiebreak) - 1 AS pos, {mask('line')} AS template FROM lines) AS l
        WHERE user_id IN (SELECT user_id FROM coded WHERE {RARE} = 1) GROUP BY user_id""",
    LINES,
)
put(
    "s4_detections_round_trip",
    "session_id:s label:i is_detected:i lead_time_minutes:d alert_loss:d final_log:s tp:i fp:i f1:d",
    f"""SELECT session_id, label, predicted AS is_detected, CASE WHEN predicted = 1 THEN lead_min END AS lead_time_minutes,
               CASE WHEN predicted = 1 THEN alert_loss END AS alert_loss, substr(last_event, 1, 50) || '...' AS final_log, tp, fp, f1
        FROM det CROSS JOIN ({metrics('cf')}) AS m""",
    f"{THRESHOLD}, {CONF.format(t='det')}",
)
put(
    "s5_load_threshold",
    "source:s threshold:d",
    """SELECT 'tuned' AS source, avg(max_loss) + 2 * stddev_pop(max_loss) AS threshold FROM sl WHERE label = 0
       UNION ALL SELECT 'default', 5.0""",
    LOSSES,
)
_VOCAB = """SELECT event, 2 + row_number() OVER (ORDER BY event) AS token_id
    FROM (SELECT DISTINCT event FROM ev WHERE label = 0 AND event IS NOT NULL) AS u"""
_SPECIAL = f"SELECT '{PAD}' AS event, 0 AS token_id UNION ALL SELECT '{UNK}', 1 UNION ALL SELECT '{SEP}', 2"
put("s6_vocab_round_trip", "event:s token_id:i", f"{_SPECIAL} UNION ALL SELECT * FROM ({_VOCAB}) AS v", DAY)
_PATTERN = f"""SELECT category, count(*) AS total, count(*) FILTER (lead_min > 0) AS anticipated,
    avg(lead_min) FILTER (lead_min > 0) AS mean_anticipated, avg(lead_min) FILTER (lead_min <= 0) AS mean_not_anticipated,
    100.0 * count(*) FILTER (lead_min > 0) / count(*) AS rate_pct FROM det WHERE {TP} GROUP BY category"""
_PATTERN_COLUMNS = "category:s total:i anticipated:i mean_anticipated:d mean_not_anticipated:d rate_pct:d"
put("s7_report_table", _PATTERN_COLUMNS, _PATTERN, TOPK)

# -- rows and scalar functions ------------------------------------------------

put("p1_normal_rows", "session_id:i tiebreak:i event:s", "SELECT * FROM ev WHERE label = 0 AND event IS NOT NULL", GAPPY)
put(
    "p2_filter_label",
    "tiebreak:i event:s kept:s",
    """SELECT tiebreak, event, '1' AS kept FROM ev WHERE label = 1 AND event IS NOT NULL
       UNION ALL SELECT tiebreak, event, 'all' FROM ev WHERE event IS NOT NULL""",
    GAPPY,
)
put(
    "p3_null_event",
    "tiebreak:i scored_as:s encoded_as:s",
    f"SELECT tiebreak, coalesce(event, '') AS scored_as, coalesce(event, '{UNK}') AS encoded_as FROM ev",
    GAPPY,
)
put("p4_epoch_ts", "event_id:i ts:t", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
put(
    "p5_short_desc",
    "doc_id:i dotted:s plain:s",
    "SELECT doc_id, substr(text, 1, 50) || '...' AS dotted, substr(text, 1, 50) AS plain FROM documents",
)
put("p6_pattern_hash", "doc_id:i log_hash:s", "SELECT doc_id, substr(md5(substr(text, 1, 50)), 1, 8) AS log_hash FROM documents")

_BLANKS = text(txt.BLANKS)
_MARKS = " ".join(
    f"WHEN strpos(t, '{m}') > 1 THEN trim(left(t, strpos(t, '{m}') - 1), {_BLANKS})" for m in txt.CUT_MARKS
)
put(
    "p7_short_label_os",
    "doc_id:i short:s",
    f"""SELECT doc_id, CASE WHEN raw IS NULL THEN '{txt.UNKNOWN_LABEL}' WHEN starts_with(t, 'Failure') THEN '{txt.FAILURE_LABEL}'
          ELSE trim(CASE WHEN length(line) <= 120 THEN line WHEN strpos(line, ':') BETWEEN 2 AND 100 THEN left(line, strpos(line, ':') + 59)
               ELSE left(line, 120) END, ' "') || CASE WHEN length(body) > 120 THEN '...' ELSE '' END END AS short
        FROM (SELECT *, trim(split_part(body, chr(10), 1), {_BLANKS}) AS line FROM (
              SELECT *, CASE {_MARKS} ELSE t END AS body FROM (
              SELECT *, trim(trim(raw, {_BLANKS}), '"') AS t FROM (
              SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN ' "Failure of ' || text
                WHEN 2 THEN text || ' Traceback (most recent call last): ' || text
                WHEN 3 THEN '"nova: ' || replace(text, chr(10), ' ') || ' None None None File'
                WHEN 4 THEN lang || ' None File ' || text END AS raw FROM documents) AS a) AS b) AS c) AS d""",
)
put(
    "p8_short_label_hdfs",
    "doc_id:i short:s",
    f"""SELECT doc_id, CASE WHEN t IS NULL THEN '{txt.UNKNOWN_LABEL}' WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS short
        FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN trim(' ' || chr(9) || text || chr(10), {_BLANKS}) END AS t
              FROM documents) AS a""",
)
TIMED = f"{CODED}, timed AS (SELECT event_id, CASE WHEN code <> 99 THEN (code - 20) * value END AS minutes FROM coded)"
_UNITS = num.DURATION_UNITS
put(
    "p9_duration_text",
    "event_id:i duration:s",
    f"""SELECT event_id, CASE WHEN minutes IS NULL THEN '{num.NO_DURATION}'
          WHEN abs(minutes) < 1 THEN format('{{:.1f}} {_UNITS[0]}', minutes * 60) WHEN abs(minutes) < 60 THEN format('{{:.1f}} {_UNITS[1]}', minutes)
          WHEN abs(minutes) < 1440 THEN format('{{:.1f}} {_UNITS[2]}', minutes / 60) ELSE format('{{:.1f}} {_UNITS[3]}', minutes / 1440) END AS duration
        FROM timed""",
    TIMED,
)


def bands(column: str, cuts: list, names: list) -> str:
    cases = " ".join(f"WHEN {column} > {c} THEN '{n}'" for c, n in zip(cuts, names))
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} WHEN {column} = {cuts[-1]} THEN '{names[-2]}' ELSE '{names[-1]}' END"


def bins(column: str, edges: list) -> str:
    cases = [f"WHEN {column} >= {edges[-1]} THEN '{edges[-1]:g}+'"]
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        cases.append(f"WHEN {column} >= {lo} THEN '{lo:g}-{hi:g}'")
    return f"CASE {' '.join(cases)} END"


_OS_BAND = bands("minutes", num.OPENSTACK_CUTS, num.OPENSTACK_BANDS)
put("p10_band_openstack", "event_id:i band:s", f"SELECT event_id, {_OS_BAND} AS band FROM timed", TIMED)
_HDFS_BAND = bands("minutes", num.HDFS_CUTS, num.HDFS_BANDS)
put("p11_band_hdfs", "event_id:i band:s", f"SELECT event_id, {_HDFS_BAND} AS band FROM timed", TIMED)
put(
    "p12_bucketize",
    "event_id:i bin:s short_bin:s",
    f"SELECT event_id, {bins('minutes', num.LEAD_EDGES)} AS bin, {bins('minutes', num.SHORT_LEAD_EDGES)} AS short_bin FROM timed",
    TIMED,
)
put(
    "p13_mask_template",
    "page_id:i digest:s n_chars:i",
    f"SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, {mask('html')} AS t FROM pages) AS a",
)
put(
    "p14_event_id",
    "template:s cnt:i event_id:s",
    f"SELECT template, count(*) AS cnt, substr(md5(template), 1, 8) AS event_id FROM (SELECT {mask('line')} AS template FROM lines) AS a GROUP BY 1",
    LINES,
)
put(
    "p15_categorize",
    "page_id:i bgl:s hdfs:s openstack:s",
    f"""SELECT page_id, {rules('html', txt.BGL_RULES)} AS bgl, {rules('html', txt.HDFS_RULES)} AS hdfs,
               {rules('html', txt.OPENSTACK_RULES)} AS openstack FROM pages""",
)
put(
    "p16_perplexity",
    "event_id:i perplexity:d unbounded:i",
    """SELECT event_id, round(CASE WHEN value / 8 < 20 THEN exp(value / 8) END, 3) AS perplexity,
              CASE WHEN value / 8 < 20 THEN 0 ELSE 1 END AS unbounded FROM events""",
)
put(
    "p17_position_pct",
    "session_id:s pos:i pct:d",
    "SELECT session_id, pos, least(100.0, 100.0 * (pos + 1)::DOUBLE / n_events) AS pct FROM p",
    f"{DAY}, {POS}",
)
put("p18_event_count", "session_id:s n_events:i", "SELECT session_id, count(*) AS n_events FROM ev GROUP BY 1", DAY)

# -- sessions and windows -----------------------------------------------------

put("g1_with_position", "session_id:i tiebreak:i pos:i", "SELECT * FROM p", f"{USER}, {POS}")
put(
    "g2_session_sequences",
    "session_id:s chunk_no:i label:i n_events:i events:l",
    "SELECT session_id, 0 AS chunk_no, max(label) AS label, count(*) AS n_events, list(event ORDER BY pos) AS events FROM p GROUP BY 1",
    f"{DAY}, {POS}",
)
put("g3_session_labels", "session_id:s label:i", "SELECT session_id, max(label) AS label FROM ev GROUP BY 1", WEEK)
put(
    "g4_joined_text",
    "session_id:i chunk_no:i label:i n_events:i text:s",
    """SELECT session_id, 0 AS chunk_no, max(label) AS label, count(*) AS n_events,
              array_to_string(list(event ORDER BY pos), ' ' || chr(10) || ' ') AS text FROM p GROUP BY 1""",
    f"{TALK}, {POS}",
)
put("g4_session_head", "session_id:i head:s", "SELECT * FROM hd", f"{USER}, {POS}, {HEAD}")
put(
    "g5_session_summary",
    "session_id:s label:i start_ts:t end_ts:t n_events:i n_error_events:i last_event:s duration_sec:d",
    "SELECT * FROM ses",
    f"{WEEK}, {SUMMARY}",
)
put(
    "g6_first_error",
    "session_id:s first_error_pos:i first_error_ts:t first_error_event:s",
    """SELECT session_id, min(pos) AS first_error_pos, arg_min(ts, pos) AS first_error_ts, arg_min(event, pos) AS first_error_event
       FROM p WHERE label = 1 GROUP BY 1""",
    f"{WEEK}, {POS}",
)
put(
    "g7_split_long",
    "session_id:i tiebreak:i chunk_no:i chunk_pos:i",
    "SELECT session_id, tiebreak, pos // 25 AS chunk_no, pos % 25 AS chunk_pos FROM p",
    f"{USER}, {POS}",
)
WINDOWS = f"""{USER}, {POS}, win AS (SELECT session_id, pos // 20 AS window_no, max(label) AS label, count(*) AS n_events,
    list(event ORDER BY pos) AS events FROM p GROUP BY 1, 2)"""
put("g8_count_windows", "session_id:i window_no:i label:i n_events:i events:l", "SELECT * FROM win", WINDOWS)
put(
    "g9_sliding_windows",
    "session_id:i start_pos:i label:i events:l",
    """SELECT * FROM (SELECT session_id, pos AS start_pos, max(label) OVER w AS label, list(event) OVER w AS events FROM p
         WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS a
       WHERE start_pos % 5 = 0 AND len(events) = 20""",
    f"{USER}, {POS}",
)
put("g10_clean_windows", "session_id:i window_no:i n_events:i", "SELECT * FROM win WHERE label = 0", WINDOWS)
TOKENS = f"""{DAY}, {POS}, voc AS ({_VOCAB}),
    tok AS (SELECT session_id, pos, n_events, coalesce(token_id, 1) AS token_id FROM p LEFT JOIN voc ON p.event = voc.event)"""
put(
    "g11_pack_blocks",
    "bucket:i block_no:i tokens:l",
    """SELECT bucket, slot // 16 AS block_no, list(token_id ORDER BY slot) AS tokens FROM (
         SELECT bucket, token_id, row_number() OVER (PARTITION BY bucket ORDER BY session_id, pos) - 1 AS slot FROM (
           SELECT *, ('0x' || substr(md5(session_id), 1, 8))::BIGINT % 8 AS bucket FROM tok) AS a) AS b
       GROUP BY 1, 2 HAVING count(*) = 16""",
    TOKENS,
)
put("g12_head_events", "session_id:i pos:i event:s", "SELECT * FROM p WHERE pos < 10", f"{USER}, {POS}")
put(
    "g13_with_context",
    "session_id:i pos:i event:s context:s",
    "SELECT session_id, pos, event, concat_ws(' ', lag(event, 3) OVER w, lag(event, 2) OVER w, lag(event, 1) OVER w) AS context FROM p "
    "WINDOW w AS (PARTITION BY session_id ORDER BY pos)",
    f"{USER}, {POS}",
)
put(
    "g14_order_check",
    "session_id:i steps_back:i",
    """SELECT session_id, count(*) AS steps_back FROM (
         SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY tiebreak) AS before FROM ev) AS a
       WHERE before > ts GROUP BY 1""",
    ORDERS,
)
put("g15_event_counts", "session_id:s event:s cnt:i", "SELECT session_id, event, count(*) AS cnt FROM ev GROUP BY 1, 2", DAY)
put(
    "g15_event_counts_wide",
    "session_id:i user:i assistant:i system:i",
    """SELECT session_id, count(*) FILTER (event = 'user') AS user, count(*) FILTER (event = 'assistant') AS assistant,
              count(*) FILTER (event = 'system') AS system FROM ev GROUP BY 1""",
    TALK,
)
put(
    "g16_gap_sessions",
    "session_id:i gap_no:i start_ts:t end_ts:t n_events:i label:i",
    """SELECT session_id, gap_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events, max(label) AS label FROM (
         SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, tiebreak ROWS UNBOUNDED PRECEDING) - 1 AS gap_no FROM (
           SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, tiebreak) <= 21600000000
                          THEN 0 ELSE 1 END AS opens FROM ev) AS a) AS b GROUP BY 1, 2""",
    USER,
)

# -- vocabulary ---------------------------------------------------------------

put("v1_fit_vocab", "event:s token_id:i", f"{_SPECIAL} UNION ALL SELECT * FROM ({_VOCAB}) AS v", GAPPY)
put(
    "v2_encode",
    "session_id:s pos:i token_id:i",
    """SELECT session_id, 2 * pos AS pos, token_id FROM tok UNION ALL
       SELECT session_id, 2 * pos + 1, 2 FROM tok WHERE pos < n_events - 1""",
    TOKENS,
)
put(
    "v3_decode",
    "session_id:s pos:i event:s",
    f"SELECT session_id, pos, coalesce(voc.event, '{UNK}') AS event FROM tok LEFT JOIN voc ON tok.token_id = voc.token_id",
    TOKENS,
)
put(
    "v4_vocab_overlap",
    "normal_only:i anomaly_only:i shared:i",
    """SELECT count(*) FILTER (n > 0 AND a = 0) AS normal_only, count(*) FILTER (n = 0 AND a > 0) AS anomaly_only,
              count(*) FILTER (n > 0 AND a > 0) AS shared
       FROM (SELECT event, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 1) AS a FROM ev GROUP BY 1) AS x""",
    WEEK,
)
put(
    "v5_event_frequency",
    "event:s cnt:i rare:i",
    "SELECT event, count(*) AS cnt, CASE WHEN count(*) <= 300 THEN 1 END AS rare FROM ev GROUP BY 1",
    WEEK,
)
put(
    "v6_event_diversity",
    "n_events:i dataset:s",
    f"""SELECT count(DISTINCT event_type || ':' || code % 4) AS n_events, 'day' AS dataset FROM coded
        UNION ALL SELECT count(DISTINCT role), 'talk' FROM conversations
        UNION ALL SELECT count(DISTINCT o_orderstatus || ':' || o_orderpriority), 'orders' FROM orders""",
    CODED,
)

# -- splits -------------------------------------------------------------------

put(
    "m1_split_normal",
    "session_id:s label:i split:s",
    f"SELECT session_id, label, {split('session_id', 'label')} AS split FROM ses",
    f"{WEEK}, {SUMMARY}",
)
put(
    "m2_split_two",
    "session_id:s split:s",
    f"SELECT session_id, CASE WHEN {pct('session_id')} < 90 THEN 'train' ELSE 'val' END AS split FROM ses WHERE label = 0",
    f"{WEEK}, {SUMMARY}",
)
_WINDOW_KEY = "session_id::VARCHAR || '#' || window_no::VARCHAR"
put(
    "m3_split_windows",
    "session_id:i window_no:i split:s",
    f"SELECT session_id, window_no, CASE WHEN {pct(_WINDOW_KEY)} < 80 THEN 'train' ELSE 'val' END AS split FROM win WHERE label = 0",
    WINDOWS,
)
put(
    "m4_test_set",
    "session_id:s tiebreak:i",
    f"SELECT session_id, tiebreak FROM ev WHERE session_id IN (SELECT session_id FROM ses WHERE {split('session_id', 'label')} = 'test')",
    f"{WEEK}, {SUMMARY}",
)
put(
    "m5_split_by_time",
    "session_id:s label:i start_ts:t split:s",
    "SELECT *, CASE WHEN start_ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'train' ELSE 'test' END AS split FROM ses",
    f"{WEEK}, {SUMMARY}",
)
put(
    "m5_split_by_share",
    "session_id:s label:i start_ts:t split:s",
    """SELECT *, CASE WHEN epoch_us(start_ts) < (SELECT quantile_cont(epoch_us(start_ts), 0.8) FROM ses) THEN 'train' ELSE 'test' END AS split
       FROM ses""",
    f"{WEEK}, {SUMMARY}",
)
put(
    "m6_leakage_audit",
    "session_id:s n_splits:i anomaly_leak:i",
    f"""SELECT session_id, count(DISTINCT split) AS n_splits, max(CASE WHEN label = 1 AND split <> 'test' THEN 1 ELSE 0 END) AS anomaly_leak
        FROM (SELECT session_id, label, {split('session_id', 'label')} AS split FROM ses UNION ALL
              SELECT session_id, label, {split('session_id', 'label', '7')} FROM ses) AS a
        GROUP BY 1 HAVING count(DISTINCT split) > 1 OR max(CASE WHEN label = 1 AND split <> 'test' THEN 1 ELSE 0 END) = 1""",
    f"{WEEK}, {SUMMARY}",
)

# -- model and detection ------------------------------------------------------


def ngrams(train: str) -> str:
    """CTE ``ng``: the model table of order 2."""
    return f"""tr AS (SELECT * FROM x WHERE {train}), co AS (
      SELECT 0 AS "order", '' AS ctx, event AS next, count(*) AS cnt FROM tr GROUP BY ALL UNION ALL
      SELECT 1, prev1, event, count(*) FROM tr WHERE prev1 IS NOT NULL GROUP BY ALL UNION ALL
      SELECT 2, prev2 || chr(1) || prev1, event, count(*) FROM tr WHERE prev2 IS NOT NULL GROUP BY ALL),
    ng AS (SELECT "order", ctx, next, cnt, sum(cnt) OVER (PARTITION BY "order", ctx) AS ctx_cnt,
      row_number() OVER (PARTITION BY "order", ctx ORDER BY cnt DESC, next) AS rank FROM co)"""


WEEK_X = f"{WEEK}, {POS}, x AS (SELECT *, {split('session_id', 'session_label')} AS split FROM p)"
DAY_X = f"{DAY}, {POS}, x AS (SELECT *, {split('session_id', 'session_label')} AS split FROM p)"
_TRAIN = "split = 'train'"
put("n1_fit_next_event", "order:i ctx:s next:s cnt:i ctx_cnt:i rank:i", "SELECT * FROM ng", f"{WEEK_X}, {ngrams(_TRAIN)}")
put(
    "n1_fit_row_scope",
    "order:i ctx:s next:s cnt:i ctx_cnt:i",
    'SELECT * FROM ng WHERE "order" < 2',
    f"{WEEK_X}, {ngrams('label = 0')}",
)
put(
    "n2_topk_next",
    "order:i ctx:s next:s cnt:i ctx_cnt:i rank:i",
    'SELECT * FROM ng WHERE "order" < 2 AND rank <= 5',
    f"{DAY_X}, {ngrams(_TRAIN)}",
)
put(
    "n3_topk_miss",
    "session_id:s pos:i ts:t event:s",
    "SELECT * FROM sc WHERE split = 'test' AND NOT in_topk",
    scored(DAY, reports.TOP_K, 1),
)
put("n4_event_loss", "session_id:s pos:i split:s loss:d in_topk:i", "SELECT * FROM sc", ALL_WEEK)
put(
    "n4_event_loss_backoff",
    "session_id:s pos:i loss:d in_topk:i",
    """SELECT session_id, pos, CASE WHEN pos >= 1 THEN -ln((coalesce(c, 0) + 1.0)::DOUBLE / (n + v)::DOUBLE) END AS loss,
              CASE WHEN pos >= 1 THEN coalesce(r <= 5, false) END AS in_topk FROM (
         SELECT session_id, pos, (SELECT count(*) + 1 FROM ng WHERE "order" = 0) AS v,
           CASE WHEN k2.ctx IS NOT NULL THEN k2.ctx_cnt WHEN k1.ctx IS NOT NULL THEN k1.ctx_cnt
                ELSE (SELECT sum(cnt) FROM ng WHERE "order" = 0) END AS n,
           CASE WHEN k2.ctx IS NOT NULL THEN g2.cnt WHEN k1.ctx IS NOT NULL THEN g1.cnt ELSE g0.cnt END AS c,
           CASE WHEN k2.ctx IS NOT NULL THEN g2.rank WHEN k1.ctx IS NOT NULL THEN g1.rank ELSE g0.rank END AS r
         FROM (SELECT *, prev2 || chr(1) || prev1 AS pair FROM x) AS x
         LEFT JOIN (SELECT DISTINCT ctx, ctx_cnt FROM ng WHERE "order" = 2 AND ctx_cnt >= 20) AS k2 ON pair = k2.ctx
         LEFT JOIN (SELECT DISTINCT ctx, ctx_cnt FROM ng WHERE "order" = 1 AND ctx_cnt >= 20) AS k1 ON prev1 = k1.ctx
         LEFT JOIN ng AS g2 ON g2."order" = 2 AND g2.ctx = pair AND g2.next = event
         LEFT JOIN ng AS g1 ON g1."order" = 1 AND g1.ctx = prev1 AND g1.next = event
         LEFT JOIN ng AS g0 ON g0."order" = 0 AND g0.next = event) AS a""",
    f"{WEEK_X}, {ngrams(_TRAIN)}",
)
put("n5_session_loss", "session_id:s label:i avg_loss:d max_loss:d n_scored:i", "SELECT * FROM sl", LOSSES)
put(
    "n6_detect_topk",
    "session_id:s label:i predicted:i first_anomaly_step:i alert_pos:i alert_ts:t alert_event:s n_events:i",
    "SELECT * FROM det",
    TOPK,
)
put(
    "n7_detect_threshold",
    "session_id:s label:i predicted:i alert_pos:i alert_ts:t alert_loss:d max_loss:d last_event:s",
    "SELECT * FROM det",
    THRESHOLD,
)
put(
    "n6_detect_topk_large_k",
    "session_id:s label:i predicted:i first_anomaly_step:i alert_pos:i alert_event:s",
    "SELECT *, coalesce(alert_pos - 1, -1) AS first_anomaly_step FROM d0",
    f"{scored(FINE, 60, 1)}, {detected(WEEK_TEST, 'NOT in_topk')}",
)
WINDOW_LOG = f"""{USER.replace('ev AS', 'ev0 AS')}, ev AS (
  SELECT session_id::VARCHAR || '#' || ((row_number() OVER (PARTITION BY session_id ORDER BY ts, tiebreak) - 1) // 20)::VARCHAR AS session_id,
         ts, tiebreak, event, label FROM ev0)"""
put(
    "n6_detect_topk_windows",
    "session_id:s label:i predicted:i alert_pos:i first_error_pos:i steps_before_error:i",
    "SELECT *, first_error_pos - alert_pos AS steps_before_error FROM d0",
    f"{scored(WINDOW_LOG, 17, 1)}, {detected(WEEK_TEST, 'NOT in_topk')}",
)
_KSIGMA = f"""pos >= {reports.SKIP} AND loss > (SELECT avg(m) + stddev_pop(m) FROM (
    SELECT max(loss) AS m FROM sc WHERE split = 'val' GROUP BY session_id) AS v)"""
put(
    "n7_detect_ksigma",
    "session_id:s label:i predicted:i alert_pos:i alert_loss:d lead_min:d",
    "SELECT *, CASE WHEN predicted = 1 THEN (epoch_us(end_ts) - epoch_us(alert_ts)) / 6e7 ELSE 0.0 END AS lead_min FROM d0",
    f"{ALL_WEEK}, {detected(WEEK_TEST, _KSIGMA)}",
)
put(
    "n7_unscorable",
    "label:i n_unscorable:i",
    f"SELECT label, count(*) AS n_unscorable FROM det WHERE n_events <= {reports.SKIP} GROUP BY 1",
    THRESHOLD,
)
put(
    "n8_detect_avg_loss",
    "session_id:s label:i avg_loss:d max_loss:d n_scored:i predicted:i",
    "SELECT *, CASE WHEN avg_loss > 2.8 THEN 1 ELSE 0 END AS predicted FROM sl",
    LOSSES,
)
put(
    "n9_model_perplexity",
    "mean_loss:d n_scored:i perplexity:d",
    "SELECT avg(loss) AS mean_loss, count(loss) AS n_scored, exp(avg(loss)) AS perplexity FROM sc WHERE split = 'val'",
    ALL_WEEK,
)
put(
    "n10_unseen_event_alert",
    "session_id:s n_unseen:i first_unseen_ts:t",
    """SELECT session_id, count(*) AS n_unseen, min(ts) AS first_unseen_ts FROM ev
       WHERE event NOT IN (SELECT event FROM ev WHERE label = 0) GROUP BY 1""",
    DAY,
)
put(
    "n11_hybrid_detect",
    "session_id:s label:i sequence_hit:i rare_hit:i rule_hit:i predicted:i",
    """SELECT session_id, label, predicted AS sequence_hit, rare AS rare_hit, rule AS rule_hit, greatest(predicted, rare, rule) AS predicted
       FROM (SELECT det.session_id, det.label, predicted, r.rare, CASE WHEN n_events <= 2 THEN r.rule ELSE 0 END AS rule
             FROM det JOIN (SELECT session_id, max(CASE WHEN event IN (SELECT event FROM ev GROUP BY 1 HAVING count(*) <= 130) THEN 1 ELSE 0 END) AS rare,
                       max(CASE WHEN regexp_matches(event, '^error:[01]$') THEN 1 ELSE 0 END) AS rule FROM ev GROUP BY 1) AS r
             ON det.session_id = r.session_id) AS a""",
    TOPK,
)
put(
    "n12_stream_first_alert",
    "session_id:s pos:i ts:t event:s loss:d",
    f"""SELECT session_id, min(pos) AS pos, arg_min(ts, pos) AS ts, arg_min(event, pos) AS event, arg_min(loss, pos) AS loss FROM sc
        WHERE {_HIT} GROUP BY 1""",
    ALL_WEEK,
)

# -- lead time ----------------------------------------------------------------

put("l1_lead_to_end", "session_id:s predicted:i lead_min:d", "SELECT * FROM det", THRESHOLD)
put("l2_lead_to_first_error", "session_id:s alert_ts:t first_error_ts:t lead_min:d lead_sec:d", "SELECT * FROM det", TOPK)
put("l3_steps_before_error", "session_id:s steps_before_error:i", "SELECT * FROM det", TOPK)
put(
    "l4_lead_interpolated",
    "session_id:s lead_est_min:d lead_used_min:d",
    """SELECT session_id, lead_min AS lead_used_min, (epoch_us(first_error_ts) - epoch_us(start_ts)) / 6e7
         - (epoch_us(end_ts) - epoch_us(start_ts)) / 6e7 * alert_pos / n_events AS lead_est_min FROM det""",
    TOPK,
)
put(
    "l5_lead_outcome",
    "n_tp:i anticipated:i simultaneous:i reactive:i unknown:i anticipated_pct:d",
    f"""SELECT count(*) AS n_tp, count(*) FILTER (lead_min > 0) AS anticipated, count(*) FILTER (lead_min = 0) AS simultaneous,
          count(*) FILTER (lead_min < 0) AS reactive, count(*) FILTER (lead_min IS NULL) AS unknown,
          {div('100.0 * count(*) FILTER (lead_min > 0)', 'count(*)')} AS anticipated_pct FROM det WHERE {TP}""",
    TOPK,
)
_LEADS = "count(lead_min) AS n, avg(lead_min) AS mean_min, min(lead_min) AS min_min, max(lead_min) AS max_min, " \
    "stddev_samp(lead_min) AS std_min, quantile_cont(lead_min, 0.5) AS median_min"
put(
    "l6_lead_stats",
    "n:i mean_min:d min_min:d max_min:d std_min:d median_min:d over:s",
    f"""SELECT {_LEADS}, 'all' AS over FROM det WHERE {TP} UNION ALL
        SELECT {_LEADS}, 'positive' AS over FROM det WHERE {TP} AND lead_min > 0""",
    THRESHOLD,
)
put(
    "l7_lead_by_category",
    "category:s count:i mean_min:d anticipated:i max_min:d min_min:d mean_steps:d median_min:d pct_anticipated:d",
    f"""SELECT category, count(*) AS count, avg(lead_min) AS mean_min, count(*) FILTER (lead_min > 0) AS anticipated,
          max(lead_min) AS max_min, min(lead_min) AS min_min, avg(steps_before_error) AS mean_steps,
          quantile_cont(lead_min, 0.5) AS median_min, round(100.0::DOUBLE * count(*) FILTER (lead_min > 0) / count(*), 1) AS pct_anticipated
        FROM det WHERE {TP} AND lead_min IS NOT NULL GROUP BY category""",
    TOPK,
)
put(
    "l8_lead_by_event",
    "first_error_event:s count:i mean_min:d anticipated:i sample_category:s median_min:d",
    f"""SELECT first_error_event, count(*) AS count, avg(lead_min) AS mean_min, count(*) FILTER (lead_min > 0) AS anticipated,
          min(category) AS sample_category, quantile_cont(lead_min, 0.5) AS median_min
        FROM det WHERE {TP} AND lead_min IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, first_error_event LIMIT 15""",
    TOPK,
)
put(
    "l9_lead_by_signature",
    "signature:s count:i best_lead:d mean_lead:d example_id:s example_loss:d",
    f"""SELECT substr(last_event, 1, 50) || '...' AS signature, count(*) AS count, max(lead_min) AS best_lead, avg(lead_min) AS mean_lead,
          min(session_id) AS example_id, arg_min(alert_loss, session_id) AS example_loss FROM det WHERE {TP} GROUP BY 1""",
    THRESHOLD,
)
put(
    "l10_failure_diversity",
    "pattern:s count:i example_id:s example_step:i",
    f"""SELECT substr(md5(head), 1, 8) AS pattern, count(*) AS count, min(det.session_id) AS example_id,
          arg_min(first_anomaly_step, det.session_id) AS example_step FROM det JOIN hd ON det.session_id = hd.session_id WHERE {TP} GROUP BY 1""",
    f"{TOPK}, {HEAD}",
)
put(
    "l11_best_and_worst_leads",
    "session_id:s lead_min:d kind:s",
    f"""SELECT * FROM (SELECT session_id, lead_min, 'best' AS kind FROM det WHERE {TP} AND lead_min IS NOT NULL
          ORDER BY lead_min DESC, session_id LIMIT 10) AS a UNION ALL
        SELECT * FROM (SELECT session_id, lead_min, 'worst' AS kind FROM det WHERE {TP} AND lead_min IS NOT NULL
          ORDER BY lead_min, session_id LIMIT 10) AS b""",
    TOPK,
)


def shares(names: list[str], expression: str, where: str) -> str:
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""SELECT band_no, band, coalesce(n, 0) AS count, {div('100.0 * coalesce(n, 0)', 'sum(n) OVER ()')} AS pct
        FROM (VALUES {listed}) AS b(band_no, band)
        LEFT JOIN (SELECT {expression} AS found, count(*) AS n FROM det WHERE {where} GROUP BY 1) AS c ON band = found"""


put(
    "l12_lead_bands",
    "band:s band_no:i count:i pct:d",
    shares(num.OPENSTACK_BANDS, bands("lead_min", num.OPENSTACK_CUTS, num.OPENSTACK_BANDS), f"{TP} AND lead_min IS NOT NULL"),
    TOPK,
)
_BIN_NAMES = [f"{a:g}-{b:g}" for a, b in zip(num.LEAD_EDGES, num.LEAD_EDGES[1:])] + [f"{num.LEAD_EDGES[-1]:g}+"]
put(
    "l12_lead_bins",
    "band:s band_no:i count:i pct:d",
    shares(_BIN_NAMES, bins("lead_min", num.LEAD_EDGES), f"{TP} AND lead_min > 0"),
    THRESHOLD,
)


def histogram(column: str, source: str, n: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}bin_no, lo + w * bin_no AS lo, lo + w * (bin_no + 1) AS hi, count(*) AS count FROM (
      SELECT {keys}b.lo, w, CASE WHEN w > 0 THEN least(floor(({column} - b.lo) / w), {n - 1}) ELSE 0 END AS bin_no FROM {source}
      CROSS JOIN (SELECT min({column}) AS lo, (max({column}) - min({column})) / {n} AS w FROM {source}) AS b) AS h GROUP BY ALL"""


put(
    "l13_lead_histogram",
    "bin_no:i lo:d hi:d count:i",
    histogram("lead_min", "cl", 50),
    f"""{TOPK}, tp AS (SELECT lead_min FROM det WHERE {TP} AND lead_min IS NOT NULL),
    cl AS (SELECT * FROM tp WHERE lead_min BETWEEN (SELECT quantile_cont(lead_min, 0.01) FROM tp) AND (SELECT quantile_cont(lead_min, 0.99) FROM tp))""",
)
put(
    "l13_lead_histogram_zoom",
    "bin_no:i lo:d hi:d count:i",
    histogram("lead_min", "tp", 30),
    f"{TOPK}, tp AS (SELECT lead_min FROM det WHERE {TP} AND lead_min <= 60)",
)
put(
    "l14_lead_ecdf",
    "lead_min:d cum_pct:d",
    f"SELECT DISTINCT lead_min, 100.0 * cume_dist() OVER (ORDER BY lead_min) AS cum_pct FROM det WHERE {TP}",
    THRESHOLD,
)


def five(column: str) -> str:
    return ", ".join(
        f"quantile_cont({column}, {q}) AS {n}" for n, q in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))
    )


put(
    "l15_five_number",
    "category:s min:d q1:d median:d q3:d max:d count:i",
    f"""SELECT category, {five('lead_min')}, count(*) AS count FROM det WHERE {TP} AND lead_min IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3""",
    TOPK,
)
put(
    "l16_detection_vs_error",
    "session_id:s detection_pct:d error_pct:d",
    f"""SELECT session_id, least(100.0, 100.0 * alert_pos::DOUBLE / n_events) AS detection_pct,
               100.0 * first_error_pos::DOUBLE / n_events AS error_pct FROM det WHERE {TP}""",
    TOPK,
)
put("l17_loss_vs_lead", "session_id:s alert_loss:d lead_min:d", f"SELECT * FROM det WHERE {TP}", THRESHOLD)
put(
    "l18_value_frequency",
    "lead_min:d count:i",
    f"SELECT lead_min, count(*) AS count FROM det WHERE {TP} GROUP BY 1",
    THRESHOLD,
)
put(
    "l18_steps_frequency",
    "steps_before_error:i count:i",
    f"SELECT steps_before_error, count(*) AS count FROM det WHERE {TP} GROUP BY 1",
    TOPK,
)
put("l19_lead_by_pattern", _PATTERN_COLUMNS, _PATTERN, TOPK)

# -- evaluation ---------------------------------------------------------------

SCORES = f"{THRESHOLD}, sco AS (SELECT session_id, label, predicted, coalesce(max_loss, 0.0) AS score FROM det)"
put("e1_confusion", "tp:i fp:i tn:i fn:i", "SELECT * FROM cf", f"{TOPK}, {CONF.format(t='det')}")
put("e2_class_metrics", METRIC_COLUMNS, metrics("cf"), f"{THRESHOLD}, {CONF.format(t='det')}")
put(
    "e3_ksigma_threshold",
    "mean_loss:d std_loss:d k_sigma:d threshold:d",
    """SELECT avg(max_loss) AS mean_loss, stddev_pop(max_loss) AS std_loss, 8.0 AS k_sigma,
              avg(max_loss) + 8 * stddev_pop(max_loss) AS threshold FROM sl WHERE label = 0""",
    LOSSES,
)
_SEPARATION = ", ".join(
    f"{f}({s}_loss) FILTER (label = {v}) AS {n}_{s}_loss_{w}"
    for s in ("max", "avg") for n, v in (("normal", 0), ("anomaly", 1)) for w, f in (("mean", "avg"), ("std", "stddev_pop"))
)
put(
    "e4_class_separation",
    " ".join(f"{n}_{s}_loss_{w}:d" for s in ("max", "avg") for n in ("normal", "anomaly") for w in ("mean", "std"))
    + " separation_max:d separation_avg:d",
    f"""SELECT *, anomaly_max_loss_mean - normal_max_loss_mean AS separation_max, anomaly_avg_loss_mean - normal_avg_loss_mean AS separation_avg
        FROM (SELECT {_SEPARATION} FROM sl) AS a""",
    LOSSES,
)


def sweep(listed: str) -> str:
    """CTE ``sw``: metrics per (no, threshold) row of a list."""
    return f"""cn AS (SELECT no, threshold, count(*) FILTER (label = 1 AND score > threshold) AS tp, count(*) FILTER (label = 0 AND score > threshold) AS fp,
      count(*) FILTER (label = 0 AND NOT score > threshold) AS tn, count(*) FILTER (label = 1 AND NOT score > threshold) AS fn
      FROM sco CROSS JOIN {listed} GROUP BY 1, 2), sw AS ({metrics('cn')})"""


GRID = "(VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(reports.GRID)) + ") AS g(no, threshold)"
_SWEEP = f"grid_no:i threshold:d {METRIC_COLUMNS}"
put("e5_threshold_sweep", _SWEEP, "SELECT no AS grid_no, * FROM sw", f"{SCORES}, {sweep(GRID)}")
COARSE = "(VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(COARSE_GRID)) + ") AS g(no, threshold)"
put(
    "e5_threshold_sweep_censored",
    _SWEEP,
    "SELECT no AS grid_no, * FROM sw",
    f"{THRESHOLD}, sco AS (SELECT label, alert_loss AS score FROM det), {sweep(COARSE)}",
)
HELD_OUT = f"(session_label = 1 AND {pct('session_id', 'calibrate')} < 30)"
CALIBRATION = f"""{ALL_WEEK}, sco AS (SELECT session_id, max(session_label) AS label, coalesce(max(loss), 0.0) AS score FROM sc
    WHERE split = 'val' OR split = 'test' AND {HELD_OUT} GROUP BY 1), {sweep(GRID)},
    be AS (SELECT no AS grid_no, * FROM sw ORDER BY f1 DESC, threshold LIMIT 1)"""
put("e6_calibrate", _SWEEP, "SELECT * FROM be", CALIBRATION)
_STORED_HIT = f"loss > (SELECT threshold FROM be) AND pos >= {reports.SKIP}"
put(
    "n7_detect_stored_threshold",
    "session_id:s label:i predicted:i alert_pos:i alert_loss:d",
    "SELECT * FROM d0",
    f"{CALIBRATION}, {detected(f'(SELECT * FROM sc WHERE split = {chr(39)}test{chr(39)} AND NOT {HELD_OUT})', _STORED_HIT)}",
)
KS_GRID = """(SELECT no, m + no / 10.0::DOUBLE * s AS threshold FROM range(31) AS r(no)
    CROSS JOIN (SELECT avg(score) AS m, stddev_pop(score) AS s FROM sco WHERE label = 0) AS b) AS g"""
put(
    "e6_calibrate_k",
    f"{_SWEEP} k_sigma:d",
    "SELECT no AS grid_no, no / 10.0 AS k_sigma, * FROM sw ORDER BY f1 DESC, no LIMIT 1",
    f"{SCORES}, {sweep(KS_GRID)}",
)
put(
    "e7_robust_range",
    "robust_min:d robust_max:d width:d n_good:i holes:i passed:i",
    """SELECT min(threshold) FILTER (f1 > 0.7) AS robust_min, max(threshold) FILTER (f1 > 0.7) AS robust_max,
         coalesce(max(threshold) FILTER (f1 > 0.7) - min(threshold) FILTER (f1 > 0.7), 0.0) AS width, count(*) FILTER (f1 > 0.7) AS n_good,
         coalesce(max(no) FILTER (f1 > 0.7) - min(no) FILTER (f1 > 0.7) + 1 - count(*) FILTER (f1 > 0.7), 0) AS holes,
         coalesce(max(threshold) FILTER (f1 > 0.7) - min(threshold) FILTER (f1 > 0.7), 0.0) > 0.3 AS passed FROM sw""",
    f"{SCORES}, {sweep(GRID)}",
)


def uniform(part: str) -> str:
    return f"((('0x' || substr(md5('42|{part}|' || trial), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}.0::DOUBLE)"


def law_ctes(name: str, part: str, shape: str, ratio: str, trials: int) -> str:
    """CTE ``name``: (trial, part) by inverting a law over k.

    ``shape`` gives one row with least, most, mean, std and whatever ``ratio`` = P(k + 1) / P(k) uses.
    """
    return f"""{name}s AS (SELECT *, CASE WHEN std > 0 THEN greatest(least, floor(mean - 12 * std - 12)) ELSE round(mean) END::BIGINT AS low,
        CASE WHEN std > 0 THEN least(most, ceil(mean + 12 * std + 12)) ELSE round(mean) END::BIGINT AS high FROM ({shape}) AS z),
    {name}k AS (SELECT *, unnest(range(low, high + 1)) AS k FROM {name}s),
    {name}l AS (SELECT k, low, high, coalesce(sum(CASE WHEN k < high THEN ln({ratio}) ELSE 0.0 END)
        OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lw FROM {name}k),
    {name}w AS (SELECT k, low, high, exp(lw - max(lw) OVER ()) AS w FROM {name}l),
    {name}c AS (SELECT low, high, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS c FROM {name}w),
    {name} AS (SELECT trial, least(max(high), max(low) + count(*) FILTER (c < {uniform(part)})) AS {part} FROM {name}c
        CROSS JOIN range({trials}) AS t(trial) GROUP BY trial)"""


def random_ctes(table: str, trials: int) -> str:
    def binomial(name: str, part: str, n: str) -> str:
        shape = f"SELECT 0 AS least, {n} AS most, n, p, n * p AS mean, sqrt(n * p * (1 - p)) AS std FROM (SELECT ({n})::DOUBLE AS n, (tp + fn)::DOUBLE / (tp + fp + tn + fn) AS p, * FROM cf) AS y"
        return law_ctes(name, part, shape, "(n - k) / (k + 1.0::DOUBLE) * (p / (1 - p))", trials)

    return f"""{binomial('rt1', 'tp', 'tp + fn')}, {binomial('rt0', 'fp', 'fp + tn')},
      rt AS (SELECT trial, rt1.tp, rt0.fp, 0 AS tn, (SELECT tp + fn FROM cf) - rt1.tp AS fn FROM rt1 JOIN rt0 USING (trial)), rm AS ({metrics('rt')})"""


def permute_ctes(table: str, trials: int) -> str:
    shape = """SELECT greatest(0, taken - bad) AS least, least(good, taken) AS most, *, taken * good / n AS mean,
        sqrt(taken * good / n * (bad / n) * ((n - taken) / (n - 1))) AS std
      FROM (SELECT (tp + fn)::DOUBLE AS good, (fp + tn)::DOUBLE AS bad, (tp + fp)::DOUBLE AS taken, (tp + fp + tn + fn)::DOUBLE AS n FROM cf) AS y"""
    law = law_ctes("pt1", "tp", shape, "(good - k) * (taken - k) / ((k + 1.0::DOUBLE) * (bad - taken + k + 1))", trials)
    return f"""{law}, pt AS (SELECT trial, pt1.tp, cf.tp + cf.fp - pt1.tp AS fp, 0 AS tn, cf.tp + cf.fn - pt1.tp AS fn FROM pt1 CROSS JOIN cf),
      pm AS ({metrics('pt')})"""


MODEL = f"mo AS (SELECT f1 AS model_f1, tp, fp, tn, fn, accuracy FROM ({metrics('cf')}) AS z)"
_RANDOM = f"""SELECT *, {div('model_f1 - random_f1_mean', 'random_f1_std')} AS sigma_above,
    100.0 * {div('model_f1 - random_f1_mean', 'random_f1_mean')} AS improvement_pct, model_f1 - random_f1_mean > 3 * random_f1_std AS passed
    FROM (SELECT avg(f1) AS random_f1_mean, stddev_pop(f1) AS random_f1_std FROM rm) AS a CROSS JOIN mo"""
put(
    "e8_random_baseline",
    "random_f1_mean:d random_f1_std:d model_f1:d sigma_above:d improvement_pct:d passed:i",
    _RANDOM,
    f"{TOPK}, {CONF.format(t='det')}, {MODEL}, {random_ctes('det', TRIALS)}",
)
_PERMUTED = """SELECT *, p_value < 0.001 AS passed FROM (SELECT avg(f1) AS permuted_f1_mean, stddev_pop(f1) AS permuted_f1_std,
    max(f1) AS permuted_f1_best, max(model_f1) AS model_f1, avg(CASE WHEN f1 >= model_f1 THEN 1.0 ELSE 0.0 END) AS p_value
    FROM pm CROSS JOIN mo) AS a"""
put(
    "e9_permutation_test",
    "permuted_f1_mean:d permuted_f1_std:d permuted_f1_best:d model_f1:d p_value:d passed:i",
    _PERMUTED,
    f"{TOPK}, {CONF.format(t='det')}, {MODEL}, {permute_ctes('det', TRIALS)}",
)
_TRIVIAL = f"""SELECT *, model_f1 - greatest(majority_f1, all_positive_f1) AS improvement, model_f1 > greatest(majority_f1, all_positive_f1) AS passed
    FROM (SELECT CASE WHEN n0 >= n1 THEN 0.0 ELSE {div('2 * p', 'p + 1')} END AS majority_f1, {div('greatest(n0, n1)', 'n0 + n1')} AS majority_accuracy,
      {div('2 * p', 'p + 1')} AS all_positive_f1, p AS all_positive_accuracy, model_f1, accuracy AS model_accuracy
      FROM (SELECT *, tp + fn AS n1, fp + tn AS n0, {div('tp + fn', 'tp + fp + tn + fn')} AS p FROM mo) AS a) AS b"""
put(
    "e10_trivial_baselines",
    "majority_f1:d majority_accuracy:d all_positive_f1:d all_positive_accuracy:d model_f1:d model_accuracy:d improvement:d passed:i",
    _TRIVIAL,
    f"{TOPK}, {CONF.format(t='det')}, {MODEL}",
)


def rank(source: str, label: str) -> str:
    """U, AUROC and z from mid-ranks."""
    return f"""SELECT u, n1, n0, u / (n1 * n0) AS auroc,
        (u - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM (
      SELECT sum(mid) FILTER ({label} = 1) - max(n1) * (max(n1) + 1) / 2 AS u, max(n1) AS n1, max(n0) AS n0, sum(cnt * cnt - 1) AS ties FROM (
        SELECT {label}, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid,
          (count(*) OVER (PARTITION BY score))::DOUBLE AS cnt, (count(*) FILTER ({label} = 1) OVER ())::DOUBLE AS n1,
          (count(*) FILTER ({label} = 0) OVER ())::DOUBLE AS n0 FROM {source}) AS a) AS b"""


NORMAL_P = """0.5::DOUBLE - sign(z) * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-power(abs(z) * i / 4000.0::DOUBLE, 2) / 2)) FROM range(4001) AS s(i)) * abs(z) / 4000 / 3 / sqrt(2 * pi())"""


def with_p(body: str, p: str) -> str:
    """A row with the integral ``p`` over its own columns."""
    return f"SELECT *, {p} AS p_value FROM ({body}) AS q"


put("e11_rank_test", "u:d n1:i n0:i auroc:d z:d p_value:d", with_p(rank("sco", "label"), NORMAL_P), SCORES)
put(
    "e11_rank_test_documents",
    "u:d n1:i n0:i auroc:d z:d p_value:d",
    with_p(rank("(SELECT n_chars::DOUBLE AS score, toxic FROM documents JOIN labels USING (doc_id)) AS dl", "toxic"), NORMAL_P),
)
MOMENTS = f"""{SCORES}, mom AS (SELECT avg(score) FILTER (label = 1) AS mean1, avg(score) FILTER (label = 0) AS mean0,
    var_samp(score) FILTER (label = 1) AS var1, var_samp(score) FILTER (label = 0) AS var0, stddev_pop(score) FILTER (label = 1) AS std1,
    stddev_pop(score) FILTER (label = 0) AS std0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM sco)"""
put(
    "e12_welch",
    "t:d df:d p_value:d",
    with_p(
        """SELECT (mean1 - mean0) / sqrt(var1 / n1 + var0 / n0) AS t,
         power(var1 / n1 + var0 / n0, 2) / (power(var1 / n1, 2) / (n1 - 1) + power(var0 / n0, 2) / (n0 - 1)) AS df FROM mom""",
        """least(1.0::DOUBLE, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(pi())) * (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000 / 3
          * (SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(greatest(0.0::DOUBLE,
              cos(atan(abs(t) / sqrt(df)) + (pi() / 2 - atan(abs(t) / sqrt(df))) * i / 20000.0::DOUBLE)), df - 1)) FROM range(20001) AS s(i)))""",
    ),
    MOMENTS,
)
CUM = f"""{SCORES}, ds AS (SELECT score, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM sco GROUP BY 1),
    up AS (SELECT *, sum(n1) OVER (ORDER BY score) AS c1, sum(n0) OVER (ORDER BY score) AS c0, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0 FROM ds),
    dn AS (SELECT *, sum(n1) OVER (ORDER BY score DESC) AS tp, sum(n0) OVER (ORDER BY score DESC) AS fp, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0 FROM ds),
    pr AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / t1 AS recall, fp::DOUBLE / t0 AS fpr, lag(tp::DOUBLE / (tp + fp)) OVER w AS p0,
           lag(tp::DOUBLE / t1) OVER w AS r0, lag(fp::DOUBLE / t0) OVER w AS f0 FROM dn WINDOW w AS (ORDER BY score DESC))"""
put(
    "e13_ks",
    "ks:d n1:i n0:i p_value:d",
    with_p(
        "SELECT max(abs(c1::DOUBLE / t1 - c0::DOUBLE / t0)) AS ks, max(t1) AS n1, max(t0) AS n0 FROM up",
        """CASE WHEN ks * sqrt(n1 * n0 / (n1 + n0)::DOUBLE) < 0.2 THEN 1.0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (SELECT sum(
             CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * ks * ks * n1 * n0 / (n1 + n0))) FROM range(1, 101) AS s(j)))) END""",
    ),
    CUM,
)
_EFFECT = """SELECT *, CASE WHEN abs(d) >= 0.8 THEN 'LARGE' WHEN abs(d) >= 0.5 THEN 'MEDIUM' WHEN abs(d) >= 0.2 THEN 'SMALL' ELSE 'NEGLIGIBLE' END AS effect
    FROM (SELECT mean1, std1, mean0, std0, (mean1 - mean0) / sqrt((std1 * std1 + std0 * std0) / 2) AS d FROM mom) AS a"""
put("e14_cohens_d", "mean1:d std1:d mean0:d std0:d d:d effect:s", _EFFECT, MOMENTS)
put("e15_pr_curve", "score:d tp:i fp:i precision:d recall:d", "SELECT * FROM pr", CUM)
put("e15_auprc", "auprc:d", "SELECT sum((recall - r0) * (precision + p0) / 2) AS auprc FROM pr", CUM)
put("e16_roc_curve", "score:d fpr:d tpr:d", "SELECT score, fpr, recall AS tpr FROM pr", CUM)
put(
    "e16_roc_auc",
    "roc_auc:d average_precision:d",
    """SELECT sum((fpr - coalesce(f0, 0)) * (recall + coalesce(r0, 0)) / 2) AS roc_auc,
              sum((recall - coalesce(r0, 0)) * precision) AS average_precision FROM pr""",
    CUM,
)
put(
    "e17_percentiles",
    "label:i " + " ".join(f"p{q}:d" for q in PERCENTS),
    "SELECT label, " + ", ".join(f"quantile_cont(score, {q / 100}) AS p{q}" for q in PERCENTS) + " FROM sco GROUP BY 1",
    SCORES,
)
put(
    "e17_alert_loss_percentiles",
    " ".join(f"p{q}:d" for q in [10, *PERCENTS]),
    "SELECT " + ", ".join(f"quantile_cont(alert_loss, {q / 100}) AS p{q}" for q in [10, *PERCENTS]) + f" FROM det WHERE {TP}",
    THRESHOLD,
)
put(
    "e18_alert_loss_histogram",
    "label:i bin_no:i lo:d hi:d count:i",
    histogram("alert_loss", "fl", 50, "label"),
    f"{THRESHOLD}, fl AS (SELECT * FROM det WHERE predicted = 1)",
)
put(
    "e18_loss_histogram",
    "label:i bin_no:i lo:d hi:d count:i",
    histogram("score", "pos_sco", 100, "label"),
    f"{SCORES}, pos_sco AS (SELECT * FROM sco WHERE score > 0)",
)
put(
    "e19_category_report",
    "category:s total:i detected:i missed:i lead_mean:d lead_min:d lead_max:d lead_median:d recall:d",
    """SELECT category, count(*) AS total, count(*) FILTER (predicted = 1) AS detected, count(*) FILTER (predicted = 0) AS missed,
         avg(lead_min) FILTER (predicted = 1) AS lead_mean, min(lead_min) FILTER (predicted = 1) AS lead_min,
         max(lead_min) FILTER (predicted = 1) AS lead_max, quantile_cont(lead_min, 0.5) FILTER (predicted = 1) AS lead_median,
         count(*) FILTER (predicted = 1)::DOUBLE / count(*) AS recall FROM det WHERE label = 1 GROUP BY 1""",
    TOPK,
)
put(
    "e20_fn_report",
    "category:s missed:i mean_events:d short_pct:d",
    """SELECT category, count(*) AS missed, avg(n_events) AS mean_events, 100.0::DOUBLE * count(*) FILTER (n_events <= 2) / count(*) AS short_pct
       FROM det WHERE label = 1 AND predicted = 0 GROUP BY 1""",
    TOPK,
)
put(
    "e21_fp_report",
    "n_fp:i loss_min:d loss_max:d loss_mean:d n_normal:i loss_median:d pct_of_normal:d",
    """SELECT count(*) FILTER (predicted = 1) AS n_fp, min(alert_loss) FILTER (predicted = 1) AS loss_min,
         max(alert_loss) FILTER (predicted = 1) AS loss_max, avg(alert_loss) FILTER (predicted = 1) AS loss_mean, count(*) AS n_normal,
         quantile_cont(alert_loss, 0.5) FILTER (predicted = 1) AS loss_median,
         100.0::DOUBLE * count(*) FILTER (predicted = 1) / count(*) AS pct_of_normal FROM det WHERE label = 0""",
    THRESHOLD,
)


def top(kind: str, order: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT '{kind}' AS kind, * FROM det WHERE {TP} AND {where} ORDER BY {order}, session_id LIMIT 20) AS {kind}"


put(
    "e22_top_alerts",
    "kind:s session_id:s alert_loss:d lead_min:d category:s n_events:i",
    " UNION ALL ".join([top("highest_loss", "alert_loss DESC"), top("quickest", "lead_min", "lead_min > 0"), top("earliest", "lead_min DESC", "lead_min > 0")]),
    THRESHOLD,
)
put(
    "e23_length_profile",
    "label:i min:d q1:d median:d q3:d max:d",
    f"SELECT label, {five('n_events')} FROM ses GROUP BY 1",
    f"{WEEK}, {SUMMARY}",
)
put(
    "e24_dataset_profile",
    "n_rows:i n_anomalous_rows:i n_sessions:i n_anomalous_sessions:i n_templates:i anomalous_pct:d",
    """SELECT (SELECT count(*) FROM ev) AS n_rows, (SELECT sum(label) FROM ev) AS n_anomalous_rows, (SELECT count(*) FROM ses) AS n_sessions,
         (SELECT sum(label) FROM ses) AS n_anomalous_sessions, (SELECT count(DISTINCT event) FROM ev) AS n_templates,
         (SELECT 100.0 * avg(label) FROM ev) AS anomalous_pct""",
    f"{DAY}, {SUMMARY}",
)


_METRIC_NAMES = ["precision", "recall", "f1", "accuracy", "specificity"]
_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, d.{m} AS day, w.{m} AS week FROM dm AS d CROSS JOIN wm AS w" for m in _METRIC_NAMES)
put(
    "e25_compare_datasets",
    "metric:s day:d week:d winner:s week_ratio:d",
    f"SELECT *, CASE WHEN day >= week THEN 'day' ELSE 'week' END AS winner, {div('week', 'day')} AS week_ratio FROM ({_ROWS}) AS a",
    f"dm AS (WITH {TOPK}, {CONF.format(t='det')} {metrics('cf')}), wm AS (WITH {THRESHOLD}, {CONF.format(t='det')} {metrics('cf')})",
)
_EVENT_CATEGORY = rules("event", reports.CATEGORY_RULES)
put(
    "e26_category_timeline",
    "window_start:t category:s count:i",
    f"SELECT date_trunc('hour', ts) AS window_start, {_EVENT_CATEGORY} AS category, count(*) AS count FROM ev WHERE label = 1 GROUP BY 1, 2",
    DAY,
)
put(
    "e26_escalation_order",
    "category:s first_window:t count:i peak_count:i peak_window:t",
    """SELECT category, min(w) AS first_window, sum(n) AS count, max(n) AS peak_count, arg_max(w, (n, -epoch_us(w))) AS peak_window
       FROM tl GROUP BY 1""",
    f"""{DAY}, tl AS (SELECT date_trunc('day', ts)::TIMESTAMP AS w, {_EVENT_CATEGORY} AS category, count(*) AS n FROM ev WHERE label = 1 GROUP BY 1, 2)""",
)
put(
    "e27_verdicts",
    "test:s value:d passed:i verdict:s",
    f"""SELECT *, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
        SELECT 'random baseline' AS test, random_f1_mean AS value, passed FROM ({_RANDOM}) AS a UNION ALL
        SELECT 'label permutation', p_value, passed FROM ({_PERMUTED}) AS b UNION ALL
        SELECT 'threshold sensitivity', width, width > 0.3 FROM (SELECT coalesce(max(threshold) FILTER (f1 > 0.7) - min(threshold) FILTER (f1 > 0.7), 0.0)
          AS width FROM sw) AS c UNION ALL
        SELECT 'trivial baselines', improvement, passed FROM ({_TRIVIAL}) AS d UNION ALL
        SELECT 'effect size', d, abs(d) > 0.5 FROM ({_EFFECT}) AS e UNION ALL
        SELECT 'separation', auroc, auroc > 0.8 FROM ({rank('sco', 'label')}) AS f) AS g""",
    f"{MOMENTS}, {CONF.format(t='sco')}, {MODEL}, {random_ctes('sco', 100)}, {permute_ctes('sco', 100)}, {sweep(GRID)}",
)
put(
    "e28_alert_report",
    "session_id:s label:i predicted:i first_anomaly_step:i n_events:i log_desc:s log_hash:s error_template:s first_error_template:s first_error_event:s first_error_ts:t "
    "first_error_pos:i alert_ts:t lead_time_seconds:d lead_time_minutes:d alert_step_before_error:i outcome:s",
    """SELECT det.*, head AS log_desc, substr(md5(head), 1, 8) AS log_hash, 'event ' || split_part(alert_event, ':', 1) AS error_template,
         'event ' || split_part(first_error_event, ':', 1) AS first_error_template,
         lead_sec AS lead_time_seconds, lead_min AS lead_time_minutes, steps_before_error AS alert_step_before_error,
         CASE WHEN lead_min > 0 THEN 'anticipated' WHEN lead_min = 0 THEN 'simultaneous' WHEN lead_min < 0 THEN 'reactive'
              ELSE 'unknown' END AS outcome FROM det JOIN hd ON det.session_id = hd.session_id""",
    f"{TOPK}, {HEAD}",
)
put(
    "first_alerts_with_lead",
    "session_id:s alert_pos:i alert_ts:t alert_event:s first_error_ts:t first_error_event:s lead_min:d",
    f"SELECT * FROM det WHERE {TP}",
    TOPK,
)
