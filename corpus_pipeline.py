"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all its predecessor kept. All but the last return the columns of ``documents``; the last returns
the token files' rows, one for each document of the mix (a document taken twice has two).

Defined results: null and empty texts get the score of the model's bias, have fingerprint zero (so that one of all texts
without words stays), hold no benchmark window, have size 0 and so are not in the mix. Null ids, languages and sources are
values like any other; null ids come first in the token files. Very long texts go through every stage whole. Of rows
that repeat an id each is judged by its own text; in a group of near copies one row stays, of equal rows any one, which
makes no difference. Rows of the mix that agree in id, source and size are taken alike. Ties are settled by ids, then
by hashes of the rows. Empty documents, labels or benchmark give empty results, no rejection and no hit. Columns are read
by name from ``documents``; more columns, whatever they are called, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, mixing, simhash, token_files, toxicity
from cairn.llm.common import materialize, scratch_dir
from cairn.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents at or above the threshold go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each component stays."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents are taken 0, 1 or 2 times, to the sources' targets."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files in ascending order of doc_id, read back."""
    return token_files.read(token_files.write(docs, tokenizer_path()))


STAGES = [
    ("toxicity", clean),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokens),
]

#: SimHash, FTRL and the tokenizer have no SQL form; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{i}-{name}", root)
    return docs
