"""The corpus pipeline: language ID, exact and near deduplication, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns that they got. Stages judge their own input only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sized, stage
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.langid import UNKNOWN, identify, learned_from, train
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.ngram_join import link_documents
from tidemark.llm.pieces import encode
from tidemark.session import ship

LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least LEAST_SCORE; the rest have no letters, or too few."""
    ship(spark)
    own = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]  # docs may have columns that are named like results
    told = identify(docs.select(*own), train(docs, where=learned_from()), text_col=f"__c{docs.columns.index('text')}")
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    ship(spark)
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id.

    An id that several rows share goes if every one of its rows is in a group
    with a smaller id. Rows without an id stay.
    """
    ship(spark)
    linked = link_documents(docs).where("doc_id is not null")
    gone = linked.groupBy(F.col("doc_id").alias("__gone_id")).agg(F.min(F.col("component_id") < F.col("doc_id")).alias("__go")).where("__go").select("__gone_id")
    return docs.join(sized(stage(gone, "near-copies")), F.col("doc_id") == F.col("__gone_id"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixed_rows(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document: doc_id, lang, source, ids, n_pieces, round_trip, decoded_sha256."""
    ship(spark)
    return encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix),
    ("piece_encode", to_pieces),
]

#: Naive Bayes, keyed sampling and merge-dropout have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
