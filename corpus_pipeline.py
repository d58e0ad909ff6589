"""The corpus pipeline: toxicity, near-duplicates, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents, whatever their names.
Null and empty texts are clean, have no duplicates and no tokens, and are mixed
at the rate of their source; repeated rows are one document to the
near-duplicate stage; without labels nothing is rejected.  Empty tables pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm import bpe, mixing, neardup, toxicity
from wickline.llm.common import materialize, table

REJECT = 0.7
VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, scores below ``REJECT``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(toxicity.score(model, F.col("text"), spark) < REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return neardup.deduplicated(docs, shingle=5, numerator=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("source_mixing", mix_sources), ("bpe", encode)]

# A trained classifier and a public vocabulary are beyond SQL; the tests hold
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
