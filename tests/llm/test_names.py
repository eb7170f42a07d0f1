"""Columns of the caller with any name keep their values in every operator that passes rows on."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from driftloom.llm import bpe, dedup_exact, langid, line_dedup, mixing, ngram_join, quality, toxicity
from driftloom.llm.common import learnable

NAMES = ("_text", "_size", "_n", "_u", "_source", "_rate", "_cdf", "_id", "_long", "_keep", "_most", "_nth", "_gone", "_h1", "_place", "_sha", "_label", "_of")


def rows(spark):
    words = ["ka lo mi tu ra sen ka mi", "schö ber gen ung keit ver"]
    data = [(k, " ".join([words[k % 2]] * 3 + [f"w{k}"]), "xx" if k % 2 else "yy", k % 3 % 2, (k + 1) % 2, 40, "ab"[k % 2]) for k in range(24)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int, quality int, n_chars long, source string")
    return df.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in NAMES})


def operators(df):
    yield "toxicity", toxicity.scored(df, toxicity.fit(df, df.select("doc_id", "toxic"), learnable("doc_id", 5, 0)), prefix="p_")
    yield "langid", langid.identified(df, langid.fit(df, learnable("doc_id", 4, 2)), prefix="p_")
    yield "quality", quality.scored(df, quality.fit(df, df.select("doc_id", "quality"), learnable("doc_id", 5, 0)), prefix="p_")
    yield "bpe", bpe.encoded(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, prefix="p_")
    yield "lines", line_dedup.without_repeated_lines(df)
    yield "ngrams", ngram_join.one_of_each(df)
    yield "exact", dedup_exact.drop_exact_copies(df)
    yield "mixing", mixing.mixed(df, copy_col="p_copy", order_col="p_order")


def test_every_column_keeps_its_values(spark):
    df = rows(spark)
    for name, out in operators(df):
        found = out.select("doc_id", *NAMES).collect()
        assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in NAMES), name


def test_names_of_results_are_refused(spark):
    df = rows(spark).withColumn("P_Score", F.lit(1)).withColumn("P_Copy", F.lit(1)).withColumn("p_N_tokens", F.lit(1))
    with pytest.raises(ValueError):
        langid.identified(df, langid.fit(df, F.lit(False)), prefix="p_")
    with pytest.raises(ValueError):
        mixing.mixed(df, copy_col="p_copy")
    with pytest.raises(ValueError):
        bpe.encoded(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, prefix="p_")
