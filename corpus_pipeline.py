"""A corpus pipeline of five stages, each an operator of granary.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, exact_dedup, langid, mixing, near_sets, pieces
from granary.llm.queries import MIX, vocabulary

#: SQL can't express suffix automata, SimHash or tokenizers.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and those without a letter, alike at every length. Whole texts are
    read, extra columns are kept, repeated rows share their fate, and an empty table stays empty."""
    columns = docs.columns
    named = langid.identify(docs, carry=columns)
    return named.filter(F.col(named.columns[-2]) != "und").select(*columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first document of each group of equal texts: the one with the least doc_id, null ids last. Null
    counts as empty; rows that repeat the first one's id and text stay with it; whole texts are compared, and extra columns kept."""
    gone = common.written(exact_dedup.exact_classes(docs).filter("not kept").select("doc_id", "text_sha256").distinct(), "gone")
    sha = common.fresh(docs, "sha")
    hashed = docs.withColumn(sha, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return common.without(hashed, gone, {"doc_id": "doc_id", sha: "text_sha256"}).drop(sha)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first document of each component of near-duplicates: five-word shingles, similarity 0.8 at least.

    The first has the least doc_id, null ids last; rows of its set of shingles and its id stay. Texts without words
    (null, empty) are one group; whole texts are compared, however long; see near_sets for the chance to miss a pair."""
    h = common.fresh(docs, "h")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    gone = near_sets.repeated(hashed.select("doc_id", F.col(h).alias("h"), "text"))
    return common.without(hashed, gone, {"doc_id": "doc_id", h: "h"}).drop(h)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources get their target weights, in a random order. Null is a source of
    its own; rows that repeat an id draw the same number; null texts, long ones and extra columns are kept."""
    return mixing.mix(docs, **MIX).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the check that they decode to it. A null text has none; a row per row of docs."""
    return pieces.round_trips(docs, vocabulary("piece_bpe_32k.model"), carry=[c for c in docs.columns if c not in ("text", "n_chars")])


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
