"""A corpus pipeline of five operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which ``run`` writes as Parquet in the shared folder and rereads as the
next stage's ``docs``. All stages but the last return the columns of documents.

Edge cases: a null text is scored as empty, has no lines and no shingles, holds no item,
and is packed as its end id alone; documents are told apart by doc_id where stages drop
them, so rows that share one go together there; rows of a null doc_id are kept by the
filtering stages but for what their own text decides; an empty table passes through all
stages; columns beside those of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unravel.llm import decontaminate, lines, minhash, packing, toxicity
from unravel.llm.common import staged

#: The stages are fitted models, probabilistic candidate searches and a packing by
#: dynamic programming; SQL can't express them. tests/llm holds each against a
#: brute-force version.
ORACLE_SQL = None
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the input's labels."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near lines one stays; emptied documents go."""
    return lines.drop_repeated_lines(docs, equal_words=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as windows of token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
