"""Naming standards: ingestion of governance rules, grammar rules and canonical roots, and their lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import clean

#: Which states of a sheet's row are taken over.
TAKEN = {"governance": ("CONFIRMED",), "grammar": ("CANONICAL", "POLICY"), "root": ("CONFIRMED", "DEPRECATED")}


def rules(rows: DataFrame) -> DataFrame:
    """(rule_code, rule_kind, category, rule_text, status) of rows (rule_kind, rule_code, category, rule_text, status): those in a taken
    state that have a code and a text. Codes and states in upper case; of a code's rows the first by text."""
    cells = rows.select("rule_kind", F.upper(clean("rule_code")).alias("rule_code"), clean("category").alias("category"), clean("rule_text").alias("rule_text"), F.upper(clean("status")).alias("status"))
    taken = ((F.col("rule_kind") == "governance") & F.col("status").isin(*TAKEN["governance"])) | ((F.col("rule_kind") == "grammar") & F.col("status").isin(*TAKEN["grammar"]))
    kept = cells.filter(taken & (F.col("rule_code") != "") & (F.col("rule_text") != ""))
    return kept.groupBy("rule_code", "rule_kind").agg(F.min(F.struct("rule_text", "category", "status")).alias("x")).select("rule_code", "rule_kind", "x.category", "x.rule_text", "x.status")


def rule(found: DataFrame, code: str) -> DataFrame:
    return found.filter(F.col("rule_code") == code.strip().upper())


def by_category(found: DataFrame) -> DataFrame:
    """(category, n_rules, rule_codes), codes in order."""
    return found.groupBy("category").agg(F.count("*").alias("n_rules"), F.concat_ws("|", F.sort_array(F.collect_set("rule_code"))).alias("rule_codes"))


def roots(rows: DataFrame) -> DataFrame:
    """(expression, concept, root, status) of rows with all three texts, in a taken state."""
    cells = rows.select(clean("expression").alias("expression"), clean("concept").alias("concept"), clean("root").alias("root"), F.upper(clean("status")).alias("status"))
    return cells.filter(F.col("status").isin(*TAKEN["root"]) & (F.col("expression") != "") & (F.col("concept") != "") & (F.col("root") != "")).distinct()


def canonical(terms: DataFrame, found: DataFrame) -> DataFrame:
    """terms (term_id, term) with the confirmed root of their exact text, or null. Of several roots the least."""
    confirmed = found.filter("status = 'CONFIRMED'").groupBy("expression").agg(F.min("root").alias("root"))
    return terms.join(confirmed, terms["term"] == confirmed["expression"], "left").select("term_id", "term", "root")
