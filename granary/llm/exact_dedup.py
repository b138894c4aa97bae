"""Exact deduplication through content-defined chunk recipes.

A text is cut after words whose own hash says so, hence equal passages give equal chunks wherever they stand. A chunk's
identifier is a 64-bit hash, verified over the corpus: one pass over the distinct chunks (combined on the map side)
finds every hash that two different chunks share, and such chunks are named by their content instead. A document is
then its ordered list of identifiers; documents are compared by these short lists, and long texts move no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, counted_join, written

#: Closes a chunk. The mark follows a word because of that word's hash alone, so marked text has one reading only.
MARK = "\x00"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(norm: Column, mean_words: int = 64) -> Column:
    """Content-defined chunks; joined together they determine the text, and the text them."""
    marked = F.transform(
        F.split(norm, " ", -1),
        lambda w: F.concat(w, F.when(F.pmod(F.xxhash64(w), F.lit(mean_words)) == 0, F.lit(" " + MARK)).otherwise(F.lit(" "))),
    )
    return F.split(F.array_join(marked, ""), f"(?<={MARK})", -1)


def collisions(chunked: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk: (chunk_id)."""
    pairs = chunked.select(F.explode(F.arrays_zip("ids", "parts")).alias("x")).select(F.col("x.ids").alias("chunk_id"), F.col("x.parts").alias("part"))
    return pairs.distinct().groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_words: int = 64, id_bits: int = 64) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after replacing each run of white space by one space. Of equal texts the row with the
    smallest id stays. A null text counts as empty. Rows with a null id belong to their group, stay only if no member
    has an id, and then keep_id is null. Rows that repeat id and text are one document: each counts in group_size and
    they share their verdict. Whole texts are compared, however long. An empty table gives an empty result; other columns of docs aren't read, whatever their names. id_bits shortens
    the identifiers (tests force collisions by it).
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    short = F.lit((1 << (id_bits - 1)) - 1 if id_bits < 64 else -1)
    parts = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), mean_words).alias("parts"))
    chunked = written(parts.withColumn("ids", F.transform("parts", lambda c: F.xxhash64(c).bitwiseAND(short))), "chunks")
    shared = written(collisions(chunked), "collisions")
    recipe = F.col("ids").alias("recipe")
    if shared.isEmpty():
        listed = chunked.select("doc_id", "text_sha256", recipe, F.lit(None).cast("array<string>").alias("named"))
    else:
        # Chunks that share an identifier take part in the comparison by their content as well.
        keyed = chunked.withColumn("row", F.monotonically_increasing_id())
        hit = keyed.select("row", F.posexplode(F.arrays_zip("ids", "parts")).alias("pos", "x")).select("row", "pos", F.col("x.ids").alias("chunk_id"), F.col("x.parts").alias("part")).join(shared, "chunk_id", "left_semi")
        named = hit.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("hit")).select("row", F.col("hit.part").alias("named"))
        listed = keyed.join(named, "row", "left").select("doc_id", "text_sha256", recipe, "named")
    listed = listed.withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    groups = written(listed.groupBy("recipe", "named").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "groups")
    return counted_join(listed, groups, ["recipe", "named"], "group_size").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
