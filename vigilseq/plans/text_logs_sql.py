"""SQL of the queries over logs of raw text."""

from __future__ import annotations

from vigilseq.plans.oracle import CODED, LINES, POS, RARE, WEEK_X, detected, ngrams, put, split
from vigilseq.plans.text_logs import MINING, TOKEN_THRESHOLD, TOKENS

ROUNDS = 6  # of merging; more than the given logs need

PLAIN = f"""{CODED}, plain AS (
  SELECT ts, event_id AS tiebreak, user_id, CASE code % 5
    WHEN 0 THEN 'INFO DataNode Received block ' || user_id || ' of size  ' || code || ' from /10.0.0.' || (code % 7)
    WHEN 1 THEN 'INFO NameNode allocated block ' || user_id || ' for task ' || event_type || '-' || (user_id % 40) || ' now'
    WHEN 2 THEN 'WARN DataNode slow ' || event_type || ' of ' || user_id || ' took ' || code || ' ms'
    WHEN 3 THEN 'ERROR compute instance ' || event_type || '-' || (user_id % 40) || ' is ' || event_type || ' code ' || code
    ELSE 'INFO scheduler idle  since ' || user_id END AS line FROM coded)"""

SIZES = "event:s template:s cnt:i n_tokens:i n_open:i"


def texts(name: str, source: str, rules: tuple[str, ...] = ()) -> str:
    line = "line"
    for rule in rules:
        line = f"regexp_replace({line}, '{rule}', '<*>', 'g')"
    return f"{name} AS (SELECT trim(regexp_replace({line}, '[ \t]+', ' ', 'g')) AS text, * FROM {source})"


def mined(name: str, source: str, leading: int, max_values: int, share: float, variants: int) -> str:
    """CTEs that end in ``name`` (template, cnt), from ``source`` with ``text``."""
    lead = "array_to_string(list_transform(string_split(text, ' ')[1:{}], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')".format(leading)
    parts = [
        f"""{name}_d AS (SELECT row_number() OVER () AS id, text, count(*) AS cnt, string_split(text, ' ') AS toks,
              len(string_split(text, ' ')) AS n, {lead} AS lead FROM {source} WHERE text <> '' GROUP BY text)""",
        f"{name}_e AS (SELECT id, n, lead, cnt, unnest(toks) AS tok, generate_subscripts(toks, 1) AS place FROM {name}_d)",
        f"{name}_v AS (SELECT n, lead, place, tok, sum(cnt) AS cnt FROM {name}_e GROUP BY ALL)",
        f"""{name}_k AS (SELECT n, lead, place, tok FROM (SELECT *, count(*) OVER (PARTITION BY n, lead, place) AS many,
              sum(cnt) OVER (PARTITION BY n, lead, place) AS total FROM {name}_v) AS x WHERE many <= {max_values} OR cnt >= total * {share})""",
        f"""{name}_0 AS (SELECT template, sum(cnt) AS cnt FROM (SELECT e.id, any_value(e.cnt) AS cnt,
              string_agg(CASE WHEN k.tok IS NULL THEN '<*>' ELSE e.tok END, ' ' ORDER BY e.place) AS template
              FROM {name}_e AS e LEFT JOIN {name}_k AS k ON k.n = e.n AND k.lead = e.lead AND k.place = e.place AND k.tok = e.tok GROUP BY e.id) AS x GROUP BY 1)""",
    ]
    for i in range(ROUNDS):
        now, after = f"{name}_{i}", f"{name}_{i + 1}" if i < ROUNDS - 1 else name
        parts += [
            f"""{now}w AS (SELECT template, place, array_to_string(list_concat(toks[1:place - 1], ['<*>'], toks[place + 1:]), ' ') AS wider FROM (
                  SELECT template, string_split(template, ' ') AS toks, unnest(range(1, len(string_split(template, ' ')) + 1)) AS place FROM {now}) AS x
                WHERE toks[place] <> '<*>')""",
            f"""{now}c AS (SELECT template, wider FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY n DESC, place) AS no FROM (
                  SELECT *, count(*) OVER (PARTITION BY wider, place) AS n FROM {now}w) AS x WHERE n >= {variants}) AS y WHERE no = 1)""",
            f"{after} AS (SELECT coalesce(wider, template) AS template, sum(cnt) AS cnt FROM {now} LEFT JOIN {now}c USING (template) GROUP BY 1)",
        ]
    return ", ".join(parts)


def described(name: str) -> str:
    return f"""SELECT substr(md5(template), 1, 8) AS event, template, cnt, len(string_split(template, ' ')) AS n_tokens,
        len(list_filter(string_split(template, ' '), lambda t: t = '<*>')) AS n_open FROM {name}"""


def matched(name: str, source: str, known: str) -> str:
    """CTEs that end in ``name``: rows of ``source`` with the ``best`` template of ``known``, null where none fits."""
    return f"""{name}_x AS (SELECT DISTINCT text, string_split(text, ' ') AS a FROM {source}),
      {name}_t AS (SELECT template, string_split(template, ' ') AS b FROM {known}),
      {name}_m AS (SELECT text, template, len(list_filter(b, lambda t: t = '<*>')) AS n_open FROM {name}_x JOIN {name}_t
        ON len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: b[i] <> '<*>' AND a[i] <> b[i])) = 0),
      {name}_b AS (SELECT text, template AS best FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_open, template) AS no FROM {name}_m) AS y WHERE no = 1),
      {name} AS (SELECT s.*, best FROM {source} AS s LEFT JOIN {name}_b USING (text))"""


put("p13_mine_templates", SIZES, described("found"), f"{PLAIN}, {texts('tx', 'plain')}, {mined('found', 'tx', **MINING)}")
put(
    "p13_mine_masked_templates",
    SIZES,
    described("found"),
    f"{LINES}, {texts('tx', 'lines', ('blk_-?[0-9]+', '/[0-9.:]+'))}, {mined('found', 'tx', 1, 20, 0.02, 4)}",
)
put(
    "p14_match_templates",
    "tiebreak:i template:s event:s known:i",
    "SELECT tiebreak, coalesce(best, text) AS template, substr(md5(coalesce(best, text)), 1, 8) AS event, best IS NOT NULL AS known FROM hit",
    f"""{PLAIN}, {texts('tx', 'plain')}, even AS (SELECT * FROM tx WHERE user_id % 2 = 0), {mined('found', 'even', **MINING)},
        {matched('hit', 'tx', 'found')}""",
)
put(
    "p14_extend_templates",
    SIZES,
    described("(SELECT template, sum(cnt) AS cnt FROM every GROUP BY 1) AS e"),
    f"""{PLAIN}, {texts('tx', 'plain')}, calm AS (SELECT * FROM tx WHERE NOT starts_with(line, 'ERROR')),
        more AS (SELECT * FROM tx WHERE starts_with(line, 'ERROR') OR user_id % 2 = 1), {mined('found', 'calm', **MINING)},
        {matched('hit', 'more', 'found')}, rest AS (SELECT text FROM hit WHERE best IS NULL), {mined('new', 'rest', **MINING)},
        every AS (SELECT template, cnt FROM found UNION ALL SELECT best, count(*) FROM hit WHERE best IS NOT NULL GROUP BY 1 UNION ALL SELECT template, cnt FROM new)""",
)

TEXT_LOG = f"""{PLAIN}, ev AS (
  SELECT c.user_id::VARCHAR || '-w' || (epoch_us(c.ts) // 604800000000)::VARCHAR AS session_id, c.ts, tiebreak,
         CASE WHEN tiebreak % 11 > 0 THEN regexp_replace(line, '[0-9]+', '#', 'g') END AS event, {RARE} AS label
  FROM coded AS c JOIN plain ON c.event_id = tiebreak)"""
TOKEN_ROWS = f"""{TEXT_LOG}, {POS},
  tl AS (SELECT * REPLACE (coalesce(event, '') AS event), list_concat(CASE WHEN pos > 0 THEN [chr(10)] ELSE [] END,
      list_filter(string_split_regex(coalesce(event, ''), '[ \t]+'), lambda t: t <> '')) AS toks,
      {split('session_id', 'session_label')} AS split FROM p),
  tu AS (SELECT session_id, pos, split, len(toks) AS n_tokens, unnest(toks) AS event, generate_subscripts(toks, 1) AS sub FROM tl),
  x AS (SELECT *, lag(event, 1) OVER w AS prev1, lag(event, 2) OVER w AS prev2 FROM tu WINDOW w AS (PARTITION BY session_id ORDER BY pos, sub))"""


def token_losses(min_ctx: int, k: int, skip: int, most: int) -> str:
    """CTE ``ls``: (session_id, pos, n_tokens, loss, in_topk) per event with tokens."""
    return f"""{TOKEN_ROWS}, {ngrams("split = 'train'")}, ls0 AS (
      SELECT session_id, pos, n_tokens, -ln((coalesce(c, 0) + 1.0)::DOUBLE / (n + v)::DOUBLE) AS loss, coalesce(r <= {k}, false) AS in_topk FROM (
        SELECT session_id, pos, n_tokens, (SELECT count(*) + 1 FROM ng WHERE "order" = 0) AS v,
          CASE WHEN k2.ctx IS NOT NULL THEN k2.ctx_cnt WHEN k1.ctx IS NOT NULL THEN k1.ctx_cnt
               ELSE (SELECT sum(cnt) FROM ng WHERE "order" = 0) END AS n,
          CASE WHEN k2.ctx IS NOT NULL THEN g2.cnt WHEN k1.ctx IS NOT NULL THEN g1.cnt ELSE g0.cnt END AS c,
          CASE WHEN k2.ctx IS NOT NULL THEN g2.rank WHEN k1.ctx IS NOT NULL THEN g1.rank ELSE g0.rank END AS r
        FROM (SELECT *, prev2 || chr(1) || prev1 AS pair FROM x) AS x
        LEFT JOIN (SELECT DISTINCT ctx, ctx_cnt FROM ng WHERE "order" = 2 AND ctx_cnt >= {min_ctx}) AS k2 ON pair = k2.ctx
        LEFT JOIN (SELECT DISTINCT ctx, ctx_cnt FROM ng WHERE "order" = 1 AND ctx_cnt >= {min_ctx}) AS k1 ON prev1 = k1.ctx
        LEFT JOIN ng AS g2 ON g2."order" = 2 AND g2.ctx = pair AND g2.next = event
        LEFT JOIN ng AS g1 ON g1."order" = 1 AND g1.ctx = prev1 AND g1.next = event
        LEFT JOIN ng AS g0 ON g0."order" = 0 AND g0.next = event) AS a WHERE pos >= {max(1, skip)}),
    ls AS (SELECT session_id, pos, any_value(n_tokens) AS n_tokens, CASE WHEN any_value(n_tokens) >= {most} THEN 0.0::DOUBLE ELSE avg(loss) END AS loss,
      bool_and(in_topk) AS in_topk FROM ls0 GROUP BY 1, 2)"""


put(
    "g13_token_context",
    "session_id:s pos:i n_context:i digest:s",
    """SELECT session_id, pos, len(c) AS n_context, md5(array_to_string(c, ' ')) AS digest FROM (
         SELECT session_id, pos, seen[greatest(len(seen) - 11, 1):] AS c FROM (
           SELECT session_id, pos, coalesce(flatten(list(toks) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS seen
           FROM tl) AS a) AS b""",
    TOKEN_ROWS,
)
put(
    "n4_token_loss",
    "session_id:s pos:i n_tokens:i loss:d in_topk:i",
    "SELECT tl.session_id, tl.pos, len(toks) AS n_tokens, ls.loss, ls.in_topk FROM tl LEFT JOIN ls USING (session_id, pos)",
    token_losses(20, 5, 2, TOKENS),
)
put(
    "n7_detect_tokens",
    "session_id:s label:i predicted:i alert_pos:i alert_loss:d max_loss:d lead_min:d",
    "SELECT *, CASE WHEN predicted = 1 THEN (epoch_us(end_ts) - epoch_us(alert_ts)) / 6e7 ELSE 0.0 END AS lead_min FROM d0",
    f"""{token_losses(1, 5, 3, 1024)}, s AS (SELECT tl.*, ls.loss FROM tl LEFT JOIN ls USING (session_id, pos) WHERE split = 'test'),
        {detected("s", f"loss > {TOKEN_THRESHOLD}")}""",
)
put(
    "n1_update_model",
    "order:i ctx:s next:s cnt:i ctx_cnt:i rank:i",
    "SELECT * FROM ng",
    f"""{WEEK_X}, first AS (SELECT min(epoch_us(ts) // 86400000000) AS day FROM x WHERE split = 'train'),
        {ngrams("split = 'train' AND epoch_us(ts) // 86400000000 > (SELECT day FROM first)")}""",
)
