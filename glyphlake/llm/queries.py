"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import centroids, html, idfiles, licenses, lines, media, minhash, mixing, pieces, resampling, topk, toxicity, urls
from glyphlake.llm.common import table


#: Where the vocabulary files of public tokenizers are; every executor has them there.
TOKENIZER_MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
WORD_TOKENIZER = os.environ.get("WORD_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")
#: Parameters of the clustering, and of the resampling, that query and SQL share.
CLUSTERS = {"k": 8, "rounds": 10, "scale": 1024, "dims": 64, "salt": "3:"}
DRAWN = {"percent": 10, "least_words": 20, "salt": "2024:", "buckets": 10_000}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its fuzzy duplicate lines."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), spared=0).withColumnsRenamed({"_lines": "n_lines", "_dropped": "n_dropped"})


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles at 80 percent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return pieces.encode(table(spark, sf_dir, "documents"), TOKENIZER_MODEL)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, release time and deadline of every document's block in the mix of all sources."""
    order = mixing.mixed_order(table(spark, sf_dir, "documents").select("doc_id", "source"))
    named = {"_source": "source", "_block": "block", "_release": "release", "_deadline": "deadline", "_slot": "slot", "_row": "row_in_block"}
    return order.select("doc_id", *(F.col(k).alias(v) for k, v in named.items()))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's media container and of the payload read back from it."""
    return media.digests(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth embedding."""
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole embedding after ten rounds, with inertias and its centroid's digest."""
    vectors = centroids.kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", CLUSTERS["dims"])
    return centroids.summary(centroids.cluster(vectors, **CLUSTERS))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and digest of every document's token ids, as read back from the files of ids.

    The tokenizer drops white space, so words are encoded once each.
    """
    return idfiles.digests(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, by_words=True)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and the rank of those drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), **DRAWN)


OP8_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_minhash_near_dedup, op4_sentencepiece, op5_source_mixing, op6_url_filter, op7_media_columns, op8_exact_top_k, op9_license_scan, op10_html_extraction, op11_centroid_clustering, op12_token_ids, op13_importance_resampling)}
ORACLES: dict[str, str] = {"op5_source_mixing": mixing.oracle_sql(), "op6_url_filter": urls.oracle_sql(), "op8_exact_top_k": OP8_SQL, "op11_centroid_clustering": centroids.oracle_sql(**CLUSTERS), "op13_importance_resampling": resampling.oracle_sql(**DRAWN)}
