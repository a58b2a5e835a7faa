"""A corpus from raw documents to token blocks: five stages, each an operator of practicum.llm.

Every stage takes the whole of what the one before kept. All but the last return the columns of
``documents``; the last returns what it has read back from the token files: doc_id, start,
n_tokens, ids_crc32 (a document that the mix takes twice is there twice). Rows with a null doc_id,
empty texts and repeated rows are treated as the operators' docstrings say.

Token ids depend on a tokenizer library, so no SQL gives run()'s rows; tests hold every stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from practicum.llm import decontaminate, mixing, ngram_join, quality, token_output
from practicum.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.filter_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any test phrase go, however long they are."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), any_hit=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their budgets: documents stay out, or come once or repeatedly."""
    return mixing.mix_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back."""
    return token_output.write_and_read(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_blocks),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
