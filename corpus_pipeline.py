"""A corpus pipeline of operators of ``folioworks.llm``: clean, unique, redacted, mixed and tokenised documents.

Stages take (spark, docs, sf_dir).  All but the last return the columns of
``documents``, and further ones whatever their names; each works on all rows of
the one before.  Null and empty texts are clean, no copies, hold no personal
data, have no words for the mix to take and no ids; rows without an id and
repeated rows are kept until the mix, which serves each row by itself (copies
are rows that share text, not id); of copies the least id stays; equal finish
times are told apart by a hash; texts of any length are read whole; an empty
table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.llm import byte_bpe, jaccard_join, personal_data, source_mix, toxicity
from folioworks.llm.storage import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from labelled rows outside the held-out fold."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard similarity 0.8 or more)."""
    return jaccard_join.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return personal_data.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, some twice, so that sources come to their targets."""
    return source_mix.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids; digests of ids and of the decoded bytes come with them."""
    return byte_bpe.tokenized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

# Stages learn, iterate and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
