"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, fill_in_middle, ngram_jaccard, toxicity, url_filter, warc
from ._common import table
from .decontamination import contaminated_passages
from .license_scan import scan_licenses
from .lm_scoring import score_documents
from .maxscore import ORACLE_SQL as TOP_SQL
from .maxscore import top_inner_products
from .packing import pack_documents
from .spelling import ORACLE_SQL as SPELLING_SQL
from .spelling import spelling_variants
from .token_files import read_token_files, write_token_files


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dictionary = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return read_token_files(spark, files, dictionary, ids=False)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, toxicity.training_labels(table(spark, sf_dir, "labels"))))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
        "op4_url_filter": url_filter.oracle(),
        "op9_warc": warc.ORACLE_SQL,
        "op10_ngram_jaccard_join": ngram_jaccard.ORACLE_SQL,
        "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op12_exact_top_k": TOP_SQL,
        "op13_spelling_variants": SPELLING_SQL,
    }
