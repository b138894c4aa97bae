"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the weights times the wanted total, over what it holds. Each document
draws its number of copies from a Poisson distribution with that mean, by inverting the distribution at a hash of seed
and document, so a rerun draws the same. Copies are exploded and shuffled globally by a hash of document and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lookup_join, unit, written

#: A rate above this is split into equal parts with a draw each, as exp(-rate) must not vanish; TERMS is enough for one part.
PART, TERMS = 16.0, 80


def rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, by_bytes: bool = False, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, mass, rate) over all rows. Null is a source of its own, with the default weight.

    mass is rows or, with by_bytes, UTF-8 bytes of text; the result's expected mass is epochs times the input's.
    A source whose mass or weight is 0 gets rate 0.
    """
    mass = F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))) if by_bytes else F.count("*")
    per = docs.groupBy(F.col(source_col).alias("source")).agg(mass.cast("double").alias("mass"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()  # one row of two numbers
    if not total["mass"] or not total["weight"]:
        return per.select("source", "mass", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(total["mass"] * epochs) / F.col("mass")
    return per.select("source", "mass", F.when(F.col("mass") > 0, rate).otherwise(0.0).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """The cumulative distribution at 0, 1, ... TERMS - 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS - 1)), lambda k: k.cast("double")), start, step, lambda s: s["cdf"])


def mix(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, by_bytes: bool = False, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs plus copy_no (from 0) and mix_key, one row per copy, in a global random order.

    The order is that of mix_key, a hash: rows are dealt to partitions by it and sorted by it there. A null id hashes
    as the empty string; rows that repeat an id draw the same number. A null text is kept as it is. If docs has a
    column named copy_no or mix_key, the new one's name ends in an underscore. An empty table gives an empty result.
    """
    spark_rates = written(rates(docs, weights, default_weight, epochs, by_bytes, source_col, text_col), "rates")
    n_sources = spark_rates.count()
    name, key, parts, cdf = (fresh(docs, x) for x in ("copy_no", "mix_key", "rate_parts", "rate_cdf"))
    pick = fresh(docs, "source_key")
    n_parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    per = spark_rates.select(F.concat(F.lit("="), "source").alias(pick), n_parts.alias(parts), poisson_steps(F.col("rate") / n_parts).alias(cdf))
    per = per.withColumn(pick, F.coalesce(pick, F.lit("null")))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rated = lookup_join(docs.withColumn(pick, F.coalesce(F.concat(F.lit("="), source_col), F.lit("null"))), per, pick, n_sources)
    # The number of steps below u is the inverse of the distribution at u.
    draw = lambda u, steps: F.aggregate(steps, F.lit(0), lambda n, c: n + F.when(c < u, 1).otherwise(0))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: unit(seed, ident, j.cast("string"))), F.lit(0), lambda n, u: n + draw(u, F.col(cdf)))
    n = fresh(docs, "n_copies")
    many = rated.withColumn(n, copies).filter(F.col(n) > 0).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(pick, parts, cdf, n)
    many = many.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col(name).cast("string"))))
    return many.repartition(F.col(key)).sortWithinPartitions(key, id_col)
