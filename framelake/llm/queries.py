"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import bitsliced, chat, clusters, crosstokens, decontam, licenses, mixing, neardup, repeats, ring, tokens, toxicity, warc
from framelake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.sharded(table(spark, sf_dir, "documents"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048)


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, width=64)


def _rounds_sql(rounds: int) -> str:
    """The rounds unrolled: a<i> assigns, c<i> holds the centroids that a<i> is measured by."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS nearest FROM (
    SELECT v.vec_id, v.x, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c)) WHERE nearest = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (k)"""


ORACLES["op11_clusters"] = _rounds_sql(10)


@query
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.alignments(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(rows))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(table(spark, sf_dir, "pages"), min_revisit_bytes=0))


#: Base 32 of a hexadecimal digest: five bits at a time, out of two hexadecimal digits.
ORACLES["op4_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((((instr('0123456789abcdef', substr(digest, 1 + CAST((i * 5) // 4 AS INTEGER), 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', coalesce(nullif(substr(digest, 2 + CAST((i * 5) // 4 AS INTEGER), 1), ''), '0')) - 1, 0)) >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM f
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.scored(docs.withColumn("held_out", F.coalesce(toxicity.held_out(), F.lit(False))), model, ["doc_id", "held_out"])
    return scores.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
