"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.bpe import encoded
from driftloom.llm.common import learnable, small_batches, table, written
from driftloom.llm.dedup_exact import drop_exact_copies
from driftloom.llm.langid import fit, identified
from driftloom.llm.mixing import mixed
from driftloom.llm.ngram_join import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go, and those without a letter."""
    small_batches(spark)
    found = identified(docs, fit(docs, learnable("doc_id", 4, 2)), prefix="id_")
    return found.where("NOT id_rejected").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8) stays."""
    return one_of_each(docs, words=5, num=8, den=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat or shrink towards shares proportional to the square root of their rows, in a new global order."""
    return mixed(docs, seed=17, temperature=0.5, copy_col="mix_copy", order_col="mix_order").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's token count and the digests of its ids and of what they decode to."""
    import public_tokenizers as tokenizers  # only this stage needs the package

    return encoded(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).drop("text")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: SQL can't express the language stage; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
