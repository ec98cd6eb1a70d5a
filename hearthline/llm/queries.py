"""The queries of these operators, at production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import alignment, bm25, byte_bpe, html_text, jaccard, licenses, packing, quality, secrets, sentence_pieces, spellings, token_store, vectors
from hearthline.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), max_tokens=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), token_store.new_folder(spark), end_id=1)
    return token_store.read(spark, shards)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 100 = 0"), k=10)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clustered(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secrets": op3_secrets,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_store": op5_token_store,
    "op6_vectors": op6_vectors,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_bm25": op9_bm25,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_alignment": op11_alignment,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_spellings": op13_spellings,
}
#: At the scale of the oracle's tables all pairs of a label can be compared, and reached vectors listed, in SQL.
OP6_SQL = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r, a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), counts AS (SELECT x, count(*) / count(DISTINCT r) AS n FROM links GROUP BY x), lowest AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, m) AS component_id, e.vec_id = least(e.vec_id, m) AS kept
FROM embeddings e LEFT JOIN counts ON counts.x = e.vec_id LEFT JOIN lowest ON lowest.x = e.vec_id
"""

ORACLES = {"op6_vectors": OP6_SQL}
