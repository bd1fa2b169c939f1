"""The corpus pipeline: language identification, exact and near deduplication, decontamination, tokens.

Every stage takes all that its predecessor kept, written as Parquet and read again. All but the
last return the columns of documents; the last returns token identifiers by document.

Odd rows, in every stage: columns other than doc_id, text and lang are carried and not looked at,
whatever their names; a null doc_id is carried; an empty table gives an empty one; texts are read
whole, however long. Each stage's function says what becomes of nulls, empty texts, ties and
repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe_encode, decontaminate, exact_dedup, langid, minhash_forest
from quire.llm.common import spread, stage

VOCABULARY = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others are rejected, and with them null, empty and letterless texts. Repeated rows are judged alike and all stay or go; ties go to the first language by name."""
    return langid.accepted(spread(docs), langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z lower-cased; null equals empty): the largest doc_id, null the least; of repeated rows one."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8; the smallest doc_id stays. Texts without words and rows without doc_id are in no group and stay; rows that repeat a doc_id stay or go together."""
    return minhash_forest.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none and stay; repeated rows stay or go together; items of fewer than six words drop nothing."""
    return decontaminate.clean(spread(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every row, repeated ones too, and the digest of what they decode to; null and empty texts have none."""
    import public_tokenizers

    return bpe_encode.tokenised(spread(docs), public_tokenizers.path(VOCABULARY))


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_forest", near), ("decontamination", decontaminated), ("byte_bpe", tokens)]
#: The stages aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stage(docs, f"pipeline-{name}")
    return docs
