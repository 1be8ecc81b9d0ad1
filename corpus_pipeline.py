"""The training-data pipeline: five stages over ``documents``.

1. ``toxicity`` – documents that the classifier rejects go;
2. ``exact_dedup`` – of equal texts the smallest id stays;
3. ``ngram_join`` – of documents that link (five-word shingles, Jaccard 0.8) the smallest id stays;
4. ``mix`` – sources are replicated to weights, the square roots of their sizes, and shuffled;
5. ``byte_bpe`` – each document's ids, counted and hashed, and its decoded bytes hashed.

The toxicity classifier is learnt from the ``labels`` beside the documents, from
the rows whose ``crc32(doc_id) mod 5`` is not 0.

Defined results: an empty table of documents gives an empty result; a null text
is empty; rows that repeat an id go or stay together by their texts, as the
operators say; rows with a null id stay unless a text equal to theirs does;
further columns travel along, whatever their names; without labels nothing is
toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfed.llm import byte_bpe, exact_dedup, ngram_join, poisson_mix, toxicity
from loomfed.llm.language_id import fold_of
from loomfed.llm.shared import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from this stage's own input and the labels; keeps what is not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = fold_of("doc_id", 5) != 0
    model = toxicity.train(docs.filter(learn), labels.filter(learn))
    return toxicity.drop_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mix", mix_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The first stage is a learnt classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
