"""The named queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from specgrade.llm import chat, jaccard, langid, merkle, minhash, mixing, ngram_lm, packing, pii, resample, topk, vector_codes, warc
from specgrade.llm.common import crc_mod, spread
from specgrade.session import local_table, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.summary(_table(spark, folder, "documents"))


@_query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), TOKENIZER)


@_query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, out="lang_pred", score="score").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@_query
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, folder, "documents"), words=3, threshold=Fraction(9, 10))


@_query
def op7_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", mixing.words("text").alias("n_tokens"))
    return mixing.mix(docs, F.col("n_tokens"), evenness=0.98, max_repeats=4.0)


@_query
def op2_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    model = ngram_lm.fit(docs.where(~held_out))
    return ngram_lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@_query
def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.records(_table(spark, folder, "pages")), path)
    return warc.read(spark, path).select(
        F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE_SQL["op1_warc_revisits"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


@_query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = local_table(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(turns.union(extra)))


@_query
def op5_exact_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL["op5_exact_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op6_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, folder, "documents"))


@_query
def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


# crc32 byte by byte, with a table of the 256 remainders.
ORACLE_SQL["op11_target_resampling"] = """
WITH remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab
), texts AS (
  SELECT 'c' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), counted AS (
  SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), distinct_runs AS (
  SELECT DISTINCT f FROM counted
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM distinct_runs
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM hexed, remainders
), buckets AS (
  SELECT side, b, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), sums AS (
  SELECT coalesce(sum(n) FILTER (side = 'c'), 0) AS s_all, coalesce(sum(n) FILTER (side = 't'), 0) AS t_all FROM buckets
), gains AS (
  SELECT r.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(c.n, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS b) r CROSS JOIN sums
  LEFT JOIN buckets c ON c.b = r.b AND c.side = 'c' LEFT JOIN buckets t ON t.b = r.b AND t.side = 't'
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (b) WHERE side = 'c' GROUP BY id
), scored AS (
  SELECT d.id AS doc_id, len(d.w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words d LEFT JOIN weights USING (id) WHERE d.side = 'c'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


@_query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(_table(spark, folder, "embeddings"))


def _codes_sql(rounds: int = 4) -> str:
    """Plain assignment of all parts to all entries, once for each round."""
    assign = """a{n} AS MATERIALIZED (
  SELECT vec_id, label, p, v, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.label, x.p, x.v, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts x JOIN b{n} b USING (p)) GROUP BY ALL
)"""
    move = """b{m} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n}) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e)
)"""
    steps = [s for n in range(rounds) for s in (assign.format(n=n), move.format(n=n, m=n + 1))] + [assign.format(n=rounds)]
    return f"""
WITH good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM good, (SELECT unnest(range(4)) AS p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 256
), {", ".join(steps)}, errors AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM errors
"""


ORACLE_SQL["op13_vector_codes"] = _codes_sql()


@_query
def op12_minhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(_table(spark, folder, "documents"), words=5, threshold=Fraction(17, 20))
