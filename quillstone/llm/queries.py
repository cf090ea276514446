"""The pN_ queries: each applies a problem's operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import docpairs, leakage, neighbors, origin, personal, prose, secrets, tokenize
from quillstone.sources.tables import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return secrets.find_credentials(read_table(spark, root, "chunks")).select("chunk_key", "line_no").distinct()


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk with its credentials replaced."""
    return secrets.redact_credentials(read_table(spark, root, "chunks"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.documented(read_table(spark, root, "files")).select("file_id", "def_line")


def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Code and documentation of every documented function."""
    return docpairs.pairs(read_table(spark, root, "files"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return prose.languages(read_table(spark, root, "nlp_chunks"), read_table(spark, root, "files"))


def p3_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of each language in the prose of every code or script file."""
    return prose.shares(read_table(spark, root, "nlp_chunks"), read_table(spark, root, "files"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.nearest_pairs(read_table(spark, root, "nlp_chunks"))


def p4_neighbors(spark: SparkSession, root: str) -> DataFrame:
    """The ten neighbours of every usable vector with their cosine similarity and rank."""
    return neighbors.all_nearest(read_table(spark, root, "nlp_chunks"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return origin.not_hand_written(read_table(spark, root, "files"))


def p5_scores(spark: SparkSession, root: str) -> DataFrame:
    """What tells about the origin of every code or script file."""
    return origin.scored(read_table(spark, root, "files"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenize.encode_corpus(read_table(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    found = leakage.leaks(read_table(spark, root, "documents"), read_table(spark, root, "questions"))
    return found.select("doc_id", "item_id")


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """The ids and sources of the documents that are left once those with leaked passages are removed."""
    documents = read_table(spark, root, "documents").select("doc_id", "text", "source")
    return leakage.without_leaks(documents, read_table(spark, root, "questions")).select("doc_id", "source")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return personal.find_personal(read_table(spark, root, "documents"))


def p8_pseudonymized(spark: SparkSession, root: str) -> DataFrame:
    """Every document with placeholders for its personal information."""
    return personal.pseudonymize(read_table(spark, root, "documents"), "quillstone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_pairs, p3_found, p3_shares, p4_found, p4_neighbors, p5_found, p5_scores, p6_ids, p7_found, p7_clean, p8_found, p8_pseudonymized)}


def oracle_sql() -> dict[str, str]:
    return {}
