"""A corpus pipeline of five stages; each stage's rows are written and read again by the next.

quality classifier -> exact dedup -> near dedup -> mixing -> BPE.  All stages but
the last return the columns of ``documents``; the last one returns doc_id,
source, n_tokens, the ids, and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe, exact, mixing, quality, simhash
from wayfold.llm.store import documents, materialise, materialise_texts, sized


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine scores 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return sized(exact.drop_copies(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of operator 3: fingerprints link at 4 or fewer differing bits."""
    return sized(simhash.drop_near_duplicates(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the sources' targets, up to twice each, shuffled within shards."""
    return sized(mixing.mix(docs), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text, written here so that texts go to the kernel a few at a time, whoever reads the rows."""
    return materialise_texts(bpe.tokenised(docs, bpe.default_vocabulary()), "tokenised", 1 << 30)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", tokenise)]

#: The stages learn a model and merge by vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", 1 << 30)
    return STAGES[-1][1](spark, docs, sf_dir)


