"""A corpus from raw documents: filter by quality, drop exact and near copies, mix the sources, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlens.llm import exact_dedup, mixing, pieces, quality, resemblance
from sessionlens.llm.common import cut, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on this stage's own input, doesn't reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.deduplicated(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Two documents are near copies when the Jaccard index of their sets of five-word shingles is 0.8 or more: SimHash
    fingerprints searched through BK-trees give the pairs, the exact index decides them. Rows are told apart by
    themselves, not by their ids, so null and repeated ids are handled as in ``without_near_copies``.
    """
    return resemblance.without_near_copies(docs, width=5, least=0.8)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them."""
    return mixing.mixed(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, n_pieces, ids, round_trip."""
    return pieces.encode(docs)


STAGES = [
    ("quality", good_text),
    ("exact_dedup", exact_copies_out),
    ("near_dedup", near_copies_out),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]

#: Compression, fingerprints and the piece lattice have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
