"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are the sources' numbers of documents to the power 0.5; as many documents as there are."""
    from .poisson_mix import poisson_mix

    return poisson_mix(_table(spark, sf_dir, "documents"), copy_col="copy").select("doc_id", "copy", "source", F.length("text").alias("n_text"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_rotation import rotate

    own = rotate(_table(spark, sf_dir, "conversations"))
    return own.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ","))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fold_of, predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = train(docs.filter(~held_out))
    return predict(docs, model).withColumn("held_out", held_out)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_digests

    docs = _table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passage_chains import shared_passages

    return shared_passages(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vp_tree import VPIndex

    vectors = _table(spark, sf_dir, "embeddings")
    return VPIndex(vectors).search(vectors.filter(F.col("vec_id") % 100 == 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fold_of
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 5) == 0
    model = train(docs.filter(~held_out), _table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).withColumn("held_out", held_out)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH s AS (SELECT coalesce(source, chr(0) || 'null') AS s, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM s),
p AS (SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, range(120) t(k)),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p),
t AS (SELECT s, list(cdf ORDER BY k) AS cdf FROM c GROUP BY s),
d AS (SELECT doc_id, source, length(text) AS n_text, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u, coalesce(source, chr(0) || 'null') AS s FROM documents),
n AS (SELECT doc_id, source, n_text, len(list_filter(cdf, lambda x: x <= u)) AS n FROM d JOIN t ON d.s = t.s)
SELECT doc_id, unnest(range(n))::INT AS copy, source, n_text::INT AS n_text FROM n
"""

OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who,
         translate(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>'), chr(13) || chr(10), '  ') AS name,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sp AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
v AS (
  SELECT sp.conv_id, speaker, turn, who, said,
         '<|im_start|>' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || name END || chr(10) AS head
  FROM sp JOIN t ON sp.conv_id = t.conv_id),
e AS (
  SELECT *, length(head) AS h, length(said) + 10 AS b,
         sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn, who, said ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM v)
SELECT conv_id, 0::BIGINT AS part, speaker, count(*)::INT AS n_turns, (count(*) FILTER (who = speaker))::INT AS n_own_turns,
       string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY turn, who, said) AS rendered,
       string_agg((stop - 1 - b) || '-' || (stop - 1), ',' ORDER BY turn, who, said) FILTER (who = speaker) AS mask
FROM e GROUP BY conv_id, speaker
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM g),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, len(sh)::INT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM g
"""

OP9_SQL = r"""
WITH own AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM own WINDOW same AS (PARTITION BY body)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_poisson_mix": op1_poisson_mix,
        "op2_chat_rotation": op2_chat_rotation,
        "op3_ngram_join": op3_ngram_join,
        "op4_language_id": op4_language_id,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_passage_chains": op6_passage_chains,
        "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_vp_tree": op10_vp_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": OP1_SQL, "op2_chat_rotation": OP2_SQL, "op3_ngram_join": OP3_SQL, "op9_exact_dedup": OP9_SQL}
