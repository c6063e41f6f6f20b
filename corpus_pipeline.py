"""From raw documents to token files: quality, one of each near-copy group, decontamination, mixing, ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coilwise.llm import mixing, ngram_join, quality, templates, token_files
from coilwise.llm.shared import stored


#: Stages on word shingles link at 80 percent of five words (the op9 query has its own).
STAGE_WORDS, STAGE_SHARE = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees don't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id and digest of the text."""
    return ngram_join.one_of_each(docs, STAGE_WORDS, STAGE_SHARE, by_row=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the token files."""
    return token_files.token_digest(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _path = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trees, the components and the token ids can't be stated in SQL.
ORACLE_SQL = None
