"""The registered queries of the numbered operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import (
    clustering,
    conversations,
    extraction,
    line_dedup,
    mixing,
    multi_index,
    near_dup,
    packing,
    pii,
    segments,
    sharding,
    toxicity,
    url_filter,
    url_labels,
)
from tablemend.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        if sql:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE, END_ID = 1024, 2
MIX = {"weights": (3, 1, 2), "share": 1.5, "most": 2.0}

LINES_SQL = """
WITH lines AS (
  SELECT doc_id, i, list[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(list))) AS i)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(k.doc_id <> s.last_doc, false) AS lost FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_pareto_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_plan(table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.ingest(docs).apply(docs)
    return cleaned.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept"), 256).alias("kept_sha256"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.judge(docs, model)
    return judged.select("doc_id", F.col("__severity").alias("severity"), F.col("__toxic").alias("toxic"))


@query("op4_information_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    counts = [F.size(F.filter("spans", (lambda kind: lambda s: s["kind"] == kind)(kind))).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


@query("op5_multi_index_hashing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score
  FROM whole q JOIN whole x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


@query("op6_segment_statistics", TOP_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_k(table(spark, sf_dir, "embeddings"), scale=64, every=20, k=20)


NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)
"""


@query("op7_minhash_near_dup", NEAR_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"), 85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_jump_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The rules of the query.
URL_RULES = [
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
]


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_labels.labelled(spark))
    return url_filter.judge(pages, URL_RULES, model).select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"),
    )


@query("op9_pattern_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, SEQUENCE)
    return packing.pack(cut, SEQUENCE)


TALK_SQL = """
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: list_reduce(range(8), lambda d, i: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x)),
      4294967295), 4294967295) % 20 AS kind
  FROM conversations
), rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows
), seen AS (
  SELECT *, n - place + 1 AS behind, substr(role, 1, 1) AS r,
    CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'b' WHEN nth > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 't' ELSE 'k' END AS fault
  FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated
  FROM seen GROUP BY conv_id
), pairs AS (
  SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, r, lag(r) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM seen) GROUP BY conv_id
), best AS (
  -- Cost and audit to the end by state of the grammar (0 start, 1 behind s, 2 behind u, 3 behind a), from the end.
  SELECT conv_id, 0 AS behind, {'c': 0, 'a': ''} AS v0, {'c': 10, 'a': 'II'} AS v1, {'c': 5, 'a': 'I'} AS v2, {'c': 0, 'a': ''} AS v3
  FROM (SELECT DISTINCT conv_id FROM seen)
  UNION ALL
  SELECT conv_id, behind, least(n0, {'c': 5 + n2.c, 'a': 'I' || n2.a}, {'c': 10 + n3.c, 'a': 'II' || n3.a}),
    least(n1, {'c': 5 + n2.c, 'a': 'I' || n2.a}, {'c': 10 + n3.c, 'a': 'II' || n3.a}),
    least(n2, {'c': 5 + n3.c, 'a': 'I' || n3.a}), least(n3, {'c': 5 + n2.c, 'a': 'I' || n2.a})
  FROM (
    SELECT conv_id, behind,
      least({'c': 2 + v0.c, 'a': 'D' || v0.a}, CASE WHEN stays AND r = 's' THEN {'c': late + v1.c, 'a': 'K' || v1.a} END,
        CASE WHEN stays AND r = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a} END, CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a} END) AS n0,
      least({'c': 2 + v1.c, 'a': 'D' || v1.a}, CASE WHEN stays AND r = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a} END,
        CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a} END) AS n1,
      least({'c': 2 + v2.c, 'a': 'D' || v2.a}, CASE WHEN stays AND r = 'a' THEN {'c': late + v3.c, 'a': 'K' || v3.a} END,
        CASE WHEN stays THEN {'c': late + 1 + v3.c, 'a': 'R' || v3.a} END) AS n2,
      least({'c': 2 + v3.c, 'a': 'D' || v3.a}, CASE WHEN stays AND r = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a} END,
        CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a} END) AS n3
    FROM (SELECT b.*  EXCLUDE (conv_id, behind), s.conv_id, s.behind, s.r, s.fault IN ('k', 't') AS stays, CASE s.fault WHEN 't' THEN 5 ELSE 0 END AS late
          FROM best b JOIN seen s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.behind = b.behind + 1)
  )
), audits AS (
  SELECT b.conv_id, b.v0.c AS cost, b.v0.a AS audit FROM best b JOIN (SELECT DISTINCT conv_id, n FROM seen) s
    ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.behind = s.n
), edits AS (
  SELECT conv_id, i, audit[i] AS e, i - length(replace(left(audit, i), 'I', '')) AS inserted FROM (
    SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)
), lines AS (
  -- Every kept or inserted turn: the role of an inserted or rerolled one follows from how many turns came before.
  SELECT e.conv_id, e.i, e.e, s.role, s.text, e.e = 'K' AND s.r = 's' AS opening
  FROM edits e LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.place = e.i - e.inserted AND e.e <> 'I'
  WHERE e.e <> 'D'
), spoken AS (
  SELECT *, count(*) FILTER (NOT opening) OVER (PARTITION BY conv_id ORDER BY i) AS speaker FROM lines
), told_again AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN speaker % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha FROM spoken GROUP BY conv_id
)
SELECT c.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
  coalesce(t.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit,
  coalesce(g.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told_again g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_suffix_dawg_repair", TALK_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(turns), turns.select("conv_id"))


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, rid, v, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
    SELECT w.vec_id, w.rid, w.v, m.c, (list_inner_product(w.v, w.v) - 2 * list_inner_product(w.v, m.v) + list_inner_product(m.v, m.v))::BIGINT AS d
    FROM whole w CROSS JOIN c{r} m) GROUP BY vec_id, rid, v)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM c{r} m LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]::BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM whole QUALIFY c < {k}
), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c
"""


@query("op12_rotated_filtering", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


@query("op13_composite_density")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
