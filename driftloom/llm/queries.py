"""The queries of this subpackage over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.bpe import encoded
from driftloom.llm.common import held_out, learnable, table
from driftloom.llm.dedup_exact import exact_dedup
from driftloom.llm.langid import fit as fit_languages
from driftloom.llm.langid import identified
from driftloom.llm.line_dedup import line_report
from driftloom.llm.mixing import mixed
from driftloom.llm.neighbours import nearest
from driftloom.llm.ngram_join import near_groups
from driftloom.llm.pieces import encoded as pieces_encoded
from driftloom.llm.prefix_trie import rebuilt, trie, turns_of
from driftloom.llm.quality import fit as fit_quality
from driftloom.llm.quality import scored
from driftloom.llm.recurrent import likelihoods
from driftloom.llm.runs import periodic_runs
from driftloom.llm.toxicity import fit as fit_toxicity
from driftloom.llm.toxicity import scored as toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = fit_toxicity(docs, table(spark, sf_dir, "labels"), learnable("doc_id", 5, 0))
    found = toxicity(docs, score)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, learnable("doc_id", 4, 2))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).drop("text")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), seed=17, temperature=0.5)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit_quality(docs, table(spark, sf_dir, "labels"), learnable("doc_id", 5, 0))
    found = scored(docs, machine)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = likelihoods(table(spark, sf_dir, "documents").select("doc_id", "text"), learnable("_id", 7, 2))
    return found.select(F.col("_id").alias("doc_id"), held_out("_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


def repeating(docs: DataFrame) -> DataFrame:
    """Texts of one document in ten, by the checksum of the id, with their words from some place on replaced by a repeated stretch; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n, a = F.col("_words"), F.size("_words"), F.col("_first")
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("int")
    stretch = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, F.col("_p")), F.ceil((n - a) / F.col("_p")).cast("int"))), F.lit(1), n - a)
    found = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    found = found.withColumn("_first", F.when(n > 0, F.col("_g") % n).cast("int")).withColumn("_p", F.when(n > 0, p))
    changed = F.concat_ws(" ", F.when(a > 0, F.slice(words, F.lit(1), a)).otherwise(F.array().cast("array<string>")), stretch)
    return found.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text")), times=4, least=6)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces_encoded(docs, tokenizers.path("piece_bpe_32k.model")).drop("text")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, no, line, row_number() OVER (ORDER BY doc_id, no) AS place, list_distinct(list_filter(string_split(line, ' '), lambda w: w <> '')) AS set
  FROM l
), f AS (
  SELECT line, set, min(place) AS first FROM s WHERE len(set) > 0 GROUP BY line, set
), e AS (
  SELECT first, len(set) AS n, unnest(set) AS w FROM f
), near AS (
  SELECT DISTINCT first FROM (
    SELECT b.first FROM e a JOIN e b ON a.w = b.w AND a.first < b.first AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 8
    GROUP BY a.first, b.first, a.n, b.n
    HAVING count(*) * 10 >= 8 * (a.n + b.n - count(*)))
), gone AS (
  SELECT s.doc_id, s.no FROM s JOIN f ON s.line = f.line WHERE s.place > f.first OR f.first IN (SELECT first FROM near)
), g AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS set
  FROM w
), e AS (
  SELECT doc_id, len(set) AS n, unnest(set) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM s JOIN reach ON reach.a = s.doc_id
GROUP BY s.doc_id, set
"""

OP6_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n) OVER () / n AS rate FROM c
), p AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM p
  WHERE k < ceil(rate + 10 * sqrt(rate) + 30)
), u AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT u.doc_id, u.source, u.text, count(*) AS n
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf <= u.u
  GROUP BY ALL
), x AS (
  SELECT doc_id, source, text, unnest(range(n))::INTEGER AS copy FROM n
)
SELECT *, ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS order_key FROM x
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM r
)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
"""

OP11_SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM c
), b AS (
  SELECT h.conv_id, list_concat(coalesce(f.own[:h.h], []), h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN c f ON f.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM b
), m AS (
  SELECT conv_id, size, depth, CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].t) END AS n, md5(turns[:depth]::VARCHAR || depth) AS node,
         CASE WHEN depth > 0 THEN md5(turns[:depth - 1]::VARCHAR || (depth - 1)) END AS above FROM p
), t AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM m GROUP BY node
), k AS (
  SELECT t.*, a.conv_id AS parent_conv_id, (SELECT count(*) FROM t x WHERE x.above = t.node) AS n_children
  FROM t LEFT JOIN t a ON a.node = t.above
), u AS (
  SELECT DISTINCT a.node AS top, d.node FROM m a JOIN m d ON a.conv_id = d.conv_id AND a.depth <= d.depth
)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, (count(*) FILTER (x.n_children = 0))::BIGINT AS n_leaves,
       sum((x.n_convs - 1) * x.n)::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN u ON u.top = k.node JOIN k x ON x.node = u.node
GROUP BY ALL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_nearest": op8_nearest,
    "op9_quality": op9_quality,
    "op10_language_model": op10_language_model,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op5_ngram_join": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_nearest": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
}
