"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_rotation, curve_packing, exact_dedup, html_text, jaccard_trees, language_id, quality, suffix_dedup, topk
from .common import held_out, on_workers, scoped, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~out))
    return quality.predict(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return curve_packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trees.jaccard_components(table(spark, sf_dir, "documents"))


_QUERIES = [op1_quality, op2_language_id, op3_curve_packing, op4_exact_dedup, op5_byte_bpe, op6_html_text, op7_chat_rotation, op8_suffix_dedup, op9_topk, op10_jaccard_trees]
_SQL = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_chat_rotation": chat_rotation.ORACLE, "op9_topk": topk.ORACLE}


def _ready(query: Callable) -> Callable:
    @scoped
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _ready(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
