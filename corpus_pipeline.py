"""A training-data pipeline: five stages, each on all that its predecessor kept.

In every stage columns beyond those it names pass through, whatever their names (the last
returns its own columns), an empty table gives an empty one, and texts of any length are
taken whole.  Null ids are allowed: such rows are judged by their texts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.llm import bpe, decontaminate, language, neardup, pii
from panelweft.llm import common as C


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; learned from the labelled documents that aren't held out.

    Null, empty and letterless texts have none and go; repeated rows are judged alike.
    """
    return language.accepted(docs, language.fit(docs.filter(~language.held_out())))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id, once.

    Null and empty texts are copies of nothing and stay. Rows that repeat an id are one
    document: of them one stays. Rows without an id all stay, repeated ones too.
    """
    return neardup.without_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have no windows and stay; rows are judged one by one.
    """
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark"))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the text.

    Null texts stay null, with a null n_chars; repeated rows change alike; no row goes.
    """
    out = pii.scrub(docs, pii.QUERY_KEY, entities_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the decoded text; a null text has no ids, repeated rows are encoded alike."""
    return bpe.tokens(docs)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", remove_benchmark), ("pii", scrub), ("bpe", tokenise)]

#: Exact links by hashes, keyed surrogates and BPE aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    docs, path = C.table(spark, sf_dir, "documents"), C.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else C.stored(out, f"{path}/{name}")
    return docs
