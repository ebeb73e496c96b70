"""The queries of this subpackage and their SQL, as registered in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, collocations, html_extract, language, licenses, mixing, packing, pieces, simhash, toxicity, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_html_extract": over("pages", html_extract.html_query),
        "op2_language_id": over("documents", language.language_query),
        "op3_rotated_code_search": over("embeddings", vectors.neighbours_query),
        "op4_piece_sampling": over("documents", pieces.pieces_query),
        "op5_toxicity": lambda spark, sf_dir: toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op6_simhash_dedup": over("documents", simhash.simhash_query),
        "op7_embedding_dedup": over("embeddings", vectors.near_vectors_query),
        "op8_license_scan": over("documents", licenses.license_query),
        "op9_chat_format": over("conversations", chat.chat_query),
        "op10_packing": over("documents", packing.packing_query),
        "op11_centroids": over("embeddings", centroids.clusters_query),
        "op12_collocations": over("documents", collocations.collocations_query),
        "op13_mixing": over("documents", mixing.mixing_query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_license_scan": licenses.license_sql(), "op9_chat_format": chat.CHAT_SQL, "op11_centroids": centroids.CLUSTERS_SQL,
        "op12_collocations": collocations.COLLOCATIONS_SQL, "op13_mixing": mixing.MIXING_SQL,
    }
