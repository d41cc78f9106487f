"""One query per operator over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseq.llm import collision_search, decontamination, kd_sharding, language, mixing, periodic_runs, ppm, pq_dedup, secrets, simhash, substring_dedup, token_alignment, token_counts
from vigilseq.llm.common import read_table

SHARDS = 24

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return ppm.score_documents(read_table(spark, folder, "documents"), held_out).withColumnRenamed("id", "doc_id")


@query
def op2_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.replicate(read_table(spark, folder, "documents"))


@query
def op3_fm_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op4_pq_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = pq_dedup.near_vectors(read_table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


@query
def op5_entropy_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(read_table(spark, folder, "documents"))


@query
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


@query
def op7_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_histogram(read_table(spark, folder, "documents"))


@query
def op8_kd_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_sharding.document_shards(read_table(spark, folder, "documents"), SHARDS)


@query
def op9_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return language.documents_and_pages(read_table(spark, folder, "documents"), read_table(spark, folder, "pages"))


@query
def op10_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_collision_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = collision_search.nearest_vectors(read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op12_asof_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.document_alignment(read_table(spark, folder, "documents"))


@query
def op13_recompression_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.document_runs(read_table(spark, folder, "documents"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op3_fm_index_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS pos, ws FROM d),
h AS (SELECT doc_id, pos, sha256(array_to_string(ws[pos:pos + {substring_dedup.WINDOW - 1}], ' ')) AS h FROM w),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS no FROM h) AS n WHERE no > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later CROSS JOIN range({substring_dedup.WINDOW}) AS r(j)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SQL["op4_pq_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {pq_dedup.COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id"""

# Equal as long as the search finds every neighbour, as it does on the given tables.
SQL["op11_collision_neighbours"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.e, u.e) / (q.n * u.n) AS score
  FROM u AS q JOIN u ON q.vec_id % 50 = 0 AND q.vec_id <> u.vec_id AND len(q.e) = len(u.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _secret_sql() -> str:
    """The scan with its windows as rows; letters of the names in both cases, as its engine folds others too."""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    assign = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", names).replace("'", "''")
    runs = {"entropy_hex": "[A-Za-z0-9]+", "entropy_base64": next(c.pattern for c in secrets.CLASSES if c.name == "entropy_base64")}
    ctes, base, added = [], [], []
    blanked = "piece"
    for word in secrets.PLACEHOLDERS:
        blanked = f"regexp_replace({blanked}, '(?i){word}', '{secrets.BLANK * len(word)}', 'g')"

    def found(name: str, pattern: str) -> str:
        """CTE of the matches of a pattern: (doc, start, piece)."""
        return f"""{name}p AS (SELECT doc_id, doc, unnest(parts) AS piece, generate_subscripts(parts, 1) AS no FROM (
            SELECT doc_id, doc, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d) AS x),
          {name} AS (SELECT * FROM (SELECT *, (sum(length(piece)) OVER (PARTITION BY doc ORDER BY no) - length(piece))::BIGINT AS start
            FROM {name}p) AS y WHERE no % 2 = 0)"""

    for kind, (name, pattern, more) in enumerate(
        (
            ("assign", assign, f"length(regexp_extract(piece, '{assign}', 2)) >= {secrets.ASSIGN_LENGTH}"),
            ("access", secrets.ACCESS, "true"),
            ("hexes", secrets.HEX, "true"),
        )
    ):
        ctes.append(found(name, pattern))
        base.append(f"SELECT doc, {kind} AS kind, start, start + length(piece) AS stop FROM {name} WHERE {more}")
    for kind, c in enumerate(secrets.CLASSES, 3):
        ctes.append(found(c.name, runs[c.name]))
        whole = "regexp_full_match(piece, '[0-9a-fA-F]{20,}')" if c.name == "entropy_hex" else "true"
        added.append(
            f"""SELECT doc, {kind} AS kind, min(at_) AS start, max(at_) + {secrets.WINDOW} AS stop FROM (
              SELECT *, sum(opens) OVER (PARTITION BY doc, start ORDER BY at_) AS island FROM (
                SELECT *, CASE WHEN at_ <= lag(at_) OVER (PARTITION BY doc, start ORDER BY at_) + {secrets.WINDOW} THEN 0 ELSE 1 END AS opens FROM (
                  SELECT doc, start, start + i AS at_, piece, i FROM (SELECT doc, start, {blanked} AS piece,
                    unnest(range(0, length(piece) - {secrets.WINDOW - 1})) AS i FROM {c.name} WHERE {whole} AND NOT regexp_matches(piece, '{secrets.IDENTIFIER}')) AS a) AS b
                WHERE list_aggregate(string_split(substr(piece, i + 1, {secrets.WINDOW}), ''), 'entropy') >= {c.bits} - {secrets.TOLERANCE}
                  AND regexp_matches(substr(piece, i + 1, {secrets.WINDOW}), '[0-9]') AND regexp_matches(substr(piece, i + 1, {secrets.WINDOW}), '[A-Za-z]')
                  AND NOT contains(substr(piece, i + 1, {secrets.WINDOW}), '{secrets.BLANK}')) AS c) AS e
            GROUP BY doc, start, island"""
        )
    label = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(secrets.KINDS)) + " END"
    joined = f"string_agg({label} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{n}" for i, n in enumerate(secrets.KINDS[:3]))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS doc, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
      {", ".join(ctes)}, base AS ({" UNION ALL ".join(base)}), added AS ({" UNION ALL ".join(added)}),
      every AS (SELECT * FROM base UNION ALL SELECT * FROM added WHERE NOT EXISTS (
        SELECT 1 FROM base AS b WHERE b.doc = added.doc AND b.start <= added.start AND added.stop <= b.stop)),
      b1 AS (SELECT doc, {counts}, {joined} AS spans FROM base GROUP BY doc), e1 AS (SELECT doc, {joined} AS spans FROM every GROUP BY doc)
    SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in secrets.KINDS[:3])},
      sha256(coalesce(b1.spans, '')) AS base_sha256, coalesce(e1.spans, '') AS spans FROM d LEFT JOIN b1 USING (doc) LEFT JOIN e1 USING (doc)"""


SQL["op5_entropy_secrets"] = _secret_sql()
