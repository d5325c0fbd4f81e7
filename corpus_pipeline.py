"""Corpus pipeline: five operators in a row, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. :func:`run` writes each result as
Parquet to the shared folder and reads it back as the next stage's input.

Null and empty texts pass every stage (a null text has no words, tokens or evidence); repeated rows
are one group of near duplicates; other columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wreath.llm import feistel_shards, kneser_ney, prob_minhash, raking, winnowing
from wreath.llm.common import fold, prepare, read, stored

#: learned models, surrogate row keys and hash permutations: SQL cannot express the stages
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below one half."""
    prepare(spark)
    model = kneser_ney.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    score = "toxicity"
    while score in docs.columns:       # documents may have a column of that name
        score += "_"
    return kneser_ney.score_toxicity(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return prob_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not share a twentieth of their words with benchmark windows."""
    prepare(spark)
    return winnowing.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics."""
    prepare(spark)
    return raking.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    prepare(spark)
    return feistel_shards.shard_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
