"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.llm import bpe, decontaminate, embedding_dedup, hard_negatives, html_extraction, language_id, lexical_search, line_dedup, ngram_join, quality, sharding, suffix_dedup, token_counts
from masterline.llm.common import table

SHARDS = 24
RANK_FILE = "byte_bpe_50k.tiktoken"


def _ranks() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path(RANK_FILE))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)),
firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(l.doc_id > f.first, false) AS gone FROM lines l LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.context_table(token_counts.lengths(docs, _ranks(), public_tokenizers.PATTERN))


def _bucket(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _bucket(5) == 0
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out), "quality")
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _bucket(4) == 2
    profiles = language_id.fit(docs.where(~held_out))
    named = language_id.predict(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                  list_inner_product(a.x, b.x)::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH terms AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM documents
  UNION ALL
  SELECT 'i', item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT kind, id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
            FROM terms GROUP BY ALL),
lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM counted WHERE kind = 'd' GROUP BY id),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occurrences FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM counted WHERE kind = 'd' GROUP BY term), sums),
norms AS (SELECT id, 75 + (25 * n * docs) // occurrences AS m FROM lengths, sums),
scores AS (SELECT i.id AS item_id, d.id AS doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m)))::BIGINT AS score
           FROM counted i JOIN weights USING (term) JOIN counted d USING (term) JOIN norms ON norms.id = d.id
           WHERE i.kind = 'i' AND d.kind = 'd' GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_byte_bpe": (op1_byte_bpe, None),
    "op2_sharding": (op2_sharding, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_token_counts": (op4_token_counts, None),
    "op5_suffix_dedup": (op5_suffix_dedup, None),
    "op6_quality": (op6_quality, None),
    "op7_embedding_dedup": (op7_embedding_dedup, None),
    "op8_language_id": (op8_language_id, None),
    "op9_ngram_join": (op9_ngram_join, None),
    "op10_decontamination": (op10_decontamination, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_lexical_search": (op12_lexical_search, OP12_SQL),
    "op13_html_extraction": (op13_html_extraction, None),
}
