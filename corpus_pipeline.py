"""A corpus pipeline of five stages: language, exact copies, near copies, repeated passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import curve_packing, exact_dedup, jaccard_trees, language_id, suffix_dedup
from girder.llm.common import discard, keep, on_workers, release, scoped, table

NEAR_PARTS = 3  # rounds of the near-copy stage: five words and 0.8 make three times the keys of three words and 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected go: without a letter, or unlike every language that was learned.

    Learned from a bounded sample of the rows that name a language; if none does, only those without a
    letter go.
    """
    model = language_id.fit(docs, F.lit(True))
    if model is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return language_id.keep_known(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a five-word shingle similarity of 0.8 or more, the smallest doc_id stays (any before
    none); documents without words stay."""
    return jaccard_trees.drop_near(docs, width=5, num=80, den=100, parts=NEAR_PARTS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts; no row goes."""
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    import public_tokenizers

    return curve_packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


def _stage(f: Callable) -> Callable:
    @scoped
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return f(spark, docs, sf_dir)

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


STAGES = [("language_id", _stage(language)), ("exact_dedup", _stage(exact)), ("jaccard_trees", _stage(near)), ("suffix_dedup", _stage(passages)), ("curve_packing", _stage(pack))]

#: SQL can express neither the trained language models nor packing; the stages are tested against brute force.
ORACLE_SQL = None


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again; the tables behind it then go.

    Nulls and repeated rows are treated as each stage says; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        before, docs = docs, keep(result, name)
        release(result)
        if hasattr(before, "_kept"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
