"""Registered queries of this package, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chunk_recipes, disclosure, language, leakage, page_text, piece_sampling, repeats, shingle_join, token_counts, tool_calls, vector_dedup, whitening, zone_clusters
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def importable(spark: SparkSession) -> None:
    """Let Python workers find this library where it is installed on the driver.

    A cluster that ships it with ``--py-files`` needs nothing of this.

    Text reaches Python in batches of rows; a thousand at a time keep long texts within bounds.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    # Workers live on between tasks: they give freed memory back instead of keeping it.
    for name in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
        spark.sparkContext.environment.setdefault(name, str(1 << 20))
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def _over(name: str):
    """A query that gets the session and the rows of one table."""

    def wrap(build):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return build(spark, table(spark, folder, name), folder)

        return query

    return wrap


@_over("embeddings")
def op1_vector_dedup(spark, vectors, folder):
    return vector_dedup.near_duplicates(vectors, 0.98)


@_over("documents")
def op2_shingle_join(spark, docs, folder):
    return shingle_join.jaccard_components(docs, 4, (85, 100))


@_over("documents")
def op3_piece_sampling(spark, docs, folder):
    return piece_sampling.encode(docs)


@_over("documents")
def op4_token_counts(spark, docs, folder):
    return token_counts.token_counts(docs)


@_over("documents")
def op5_language_id(spark, docs, folder):
    return language.identify(docs)


#: What the turns of a plain dialogue must look like as calls.
TOOLS = {
    "answer": {"required": ["text"], "properties": {"text": "string", "after": "string"}},
    "note": {"required": ["of", "size"], "properties": {"of": "string", "size": "integer"}},
}


@_over("conversations")
def op6_tool_calls(spark, turns, folder):
    calls, results = tool_calls.dialogue_as_calls(turns)
    linked = tool_calls.link_calls(calls, results, TOOLS)
    # Calls in a circle have no order.
    return linked.withColumns({c: F.when(~F.col("cyclic"), F.col(c)) for c in ("order_turn", "order_place", "order_step")})


@_over("documents")
def op7_repeated_strings(spark, docs, folder):
    return repeats.remove_repeats(docs, 400)


@_over("documents")
def op8_disclosure(spark, docs, folder):
    return disclosure.find_personal_data(docs)


@_over("documents")
def op9_benchmark_leaks(spark, docs, folder):
    return leakage.find_leaks(docs, table(spark, folder, "benchmark"))


@_over("pages")
def op10_page_text(spark, pages, folder):
    return page_text.extract(pages)


@_over("documents")
def op11_chunk_recipes(spark, docs, folder):
    return chunk_recipes.exact_duplicates(docs)


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in columns})


@_over("embeddings")
def op12_whitening(spark, vectors, folder):
    return _longs(whitening.whiten(vectors), "deviation")


@_over("embeddings")
def op13_zone_clusters(spark, vectors, folder):
    return _longs(zone_clusters.cluster(vectors), "distance", "cluster_inertia", "inertia")


QUERIES: dict[str, Query] = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_shingle_join": op2_shingle_join,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_tool_calls": op6_tool_calls,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_disclosure": op8_disclosure,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_page_text": op10_page_text,
    "op11_chunk_recipes": op11_chunk_recipes,
    "op12_whitening": op12_whitening,
    "op13_zone_clusters": op13_zone_clusters,
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_REACH = """
, reach AS (
  SELECT a AS id, b AS other FROM both_ways
  UNION
  SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), root AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
"""



def _rounds(rounds: int) -> str:
    """SQL of the rounds of clustering: assignment ``near_r`` and centroids ``c_r`` of each."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""apart_{r} AS MATERIALIZED (
  SELECT vec_id, c, sum((x - m) * (x - m))::BIGINT AS distance FROM cells JOIN c_{r} USING (d) GROUP BY vec_id, c
), near_{r} AS MATERIALIZED (
  SELECT vec_id, c, distance FROM apart_{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1
)""")
        if r < rounds:
            out.append(f"""moved_{r} AS (
  SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM near_{r} JOIN cells USING (vec_id) GROUP BY c, d
), c_{r + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c_{r} LEFT JOIN moved_{r} USING (c, d)
)""")
    return ", ".join(out)


ORACLES: dict[str, str] = {
    "op11_chunk_recipes": f"""
WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), {_A_TO_Z}) AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM plain JOIN groups USING (t)
""",
    "op13_zone_clusters": f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(v) AS x FROM kept
), first AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept
), c_0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS d, unnest(v) AS m FROM first WHERE c < 40
), {_rounds(5)},
told AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c_5 GROUP BY c),
sums AS (SELECT c, sum(distance)::BIGINT AS cluster_inertia FROM near_5 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM near_5) AS inertia, centroid_sha256
FROM near_5 JOIN told USING (c) JOIN sums USING (c)
""",
    "op1_vector_dedup": f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), both_ways AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98
), links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a) {_REACH}
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN root ON root.id = e.vec_id
""",
    "op6_tool_calls": f"""
WITH RECURSIVE ends AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id
), asked AS (
  SELECT conv_id, turn, text, conv_id % 10 = 3 AND turn < 2 AND last_turn < {tool_calls.SHORT} AS sees
  FROM conversations JOIN ends USING (conv_id) WHERE role = 'user' AND turn IS NOT NULL
), follow AS (
  SELECT a.*, b.turn IS NOT NULL AS more FROM asked a LEFT JOIN asked b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
), circle AS (
  SELECT conv_id, turn FROM follow WHERE sees AND more
  UNION SELECT a.conv_id, a.turn FROM asked a JOIN circle c ON a.conv_id = c.conv_id AND a.turn = c.turn + 2
), calls AS (
  SELECT f.conv_id, f.turn::VARCHAR AS call_id, f.turn, 'answer' AS name, c.turn IS NOT NULL AS cyclic, f.turn AS order_turn,
    CASE WHEN sees THEN 1 ELSE 0 END AS order_place, CASE WHEN sees THEN 1 ELSE 0 END AS order_step,
    concat_ws('; ', CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN sees THEN 'unknown see' END) AS errors,
    '{{' || concat_ws(',', CASE WHEN f.turn >= 2 THEN '"after":"${{' || (f.turn - 2) || '}}"' END, CASE WHEN sees THEN '"see":"${{' || f.turn || 'n}}"' END,
      '"text":' || to_json(text)) || '}}' AS arguments
  FROM follow f LEFT JOIN circle c ON f.conv_id = c.conv_id AND f.turn = c.turn
  UNION ALL
  SELECT f.conv_id, f.turn || 'n', f.turn, CASE WHEN f.conv_id % 7 = 1 THEN 'memo' ELSE 'note' END, c.turn IS NOT NULL,
    CASE WHEN more THEN f.turn + 2 ELSE f.turn END, CASE WHEN more THEN 0 ELSE 1 END, CASE WHEN more THEN 1 ELSE 0 END,
    CASE WHEN f.conv_id % 7 = 1 THEN 'unknown tool' WHEN text IS NULL THEN 'missing size' WHEN length(text) % 2 = 1 THEN 'size is not integer but string' ELSE '' END,
    '{{' || concat_ws(',', '"of":"${{' || (f.turn + 2) || '}}"', '"size":' || CASE WHEN length(text) % 2 = 1 THEN '"' || length(text) || '"' ELSE length(text)::VARCHAR END) || '}}'
  FROM follow f LEFT JOIN circle c ON f.conv_id = c.conv_id AND f.turn + 2 = c.turn
), told AS (
  SELECT conv_id, (turn - 1) || CASE WHEN role = 'system' THEN 'n' ELSE '' END AS call_id, min(turn) AS result_turn, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role IN ('assistant', 'system') AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
)
SELECT coalesce(a.conv_id, t.conv_id) AS conv_id, coalesce(a.call_id, t.call_id) AS call_id, a.turn, t.result_turn,
  CASE WHEN a.conv_id IS NULL THEN 'orphan' WHEN t.conv_id IS NULL THEN 'unanswered' WHEN t.result_turn <= a.turn THEN 'early' ELSE 'linked' END AS status,
  CASE WHEN a.conv_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN NOT cyclic THEN order_turn END AS order_turn, CASE WHEN NOT cyclic THEN order_place END::INTEGER AS order_place,
  CASE WHEN NOT cyclic THEN order_step END::INTEGER AS order_step, coalesce(cyclic, false) AS cyclic, coalesce(errors, '') AS errors,
  '{{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(coalesce(a.call_id, t.call_id)) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(t.content)::VARCHAR, 'null') || '}}' AS json
FROM calls a FULL JOIN told t ON a.conv_id = t.conv_id AND a.call_id = t.call_id
""",
    "op2_shingle_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n - count(*) AS whole, count(*) AS part
  FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
), links AS (SELECT a, b FROM common WHERE 100 * part >= 85 * whole),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links) {_REACH}
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, least(sets.doc_id, coalesce(root, sets.doc_id)) AS component_id
FROM sets LEFT JOIN root ON root.id = sets.doc_id
""",
}
