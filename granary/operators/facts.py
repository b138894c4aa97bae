"""Facts about SQL scripts, as a corpus job on a declared subset of SQL.

Comments and string literals are blanked, statements are split at semicolons, identifiers are words joined by dots.
Comma joins, quoted identifiers and the scopes of aliases are not seen; what can't be resolved is never guessed. A site
with a parser supplies the same columns itself: facts() takes a function for that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import clean, normalised_sql, plain_spaces, without_comments
from granary.operators.catalog import is_small, lookup

#: Statements that write, and words after a table that are no alias.
WRITES = ("insert", "update", "delete", "merge", "create", "drop", "alter")
KEYWORDS = "where on join left right full inner outer cross group order having limit union select as using lateral set values partition".split()
CTE = r"(?:\bwith|,)\s*(\w+)\s+as\s*\("
TARGET = r"\binsert\s+(?:overwrite|into)\s+(?:table\s+)?([\w.]+)"
SOURCE = r"\b(?:from|join)\s+([\w.]+)"
ALIASED = SOURCE + r"(?:\s+(?:as\s+)?(\w+))?"
NAMED = r"(?:^|;)(?:drop|create|truncate)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?([\w.]+)"
STAR = r"(?:\bselect\s+(?:distinct\s+)?|,\s*)(?:\w+\.)?\*\s*(?:,|from\b|;|$)"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def flat(sql: Column) -> Column:
    """The text in lower case, with plain single spaces and empty literals."""
    low = F.lower(F.regexp_replace(F.regexp_replace(plain_spaces(without_comments(sql)), r"'[^']*'|\"[^\"]*\"", "''"), r"\s{2,}|[^\S ]", " "))
    return F.regexp_replace(low, r"\bextract\s*\(\s*\w+\s+from\b", "extract(")


def kind(s: Column) -> Column:
    first = F.regexp_extract(s, r"^(\w+)", 1)
    return F.when(s.startswith("with"), F.when(first != "with", first).when(s.rlike(r"\binsert\s+(?:into|overwrite)\b"), "insert").otherwise("select")).otherwise(first)


def regex_facts(scripts: DataFrame) -> DataFrame:
    """The facts' columns from text alone; see the module's head.

    No pattern reaches over a semicolon, so each meets the statements as one text, and only if that holds a word
    without which it can't match. Where a script inserts and has several statements, each is read on its own: a target that its own
    statement reads is no source."""
    none = F.array().cast("array<string>")
    each = lambda f: F.transform("statements", f)
    holds = lambda s, *words: reduce(Column.__or__, [s.contains(w) for w in words])
    found = lambda s, pattern, *words, group=1: F.when(holds(s, *words), extract(s, pattern, group)).otherwise(none)
    target = lambda s: F.slice(found(s, TARGET, "insert"), 1, 1)
    read = lambda s: F.concat(found(s, SOURCE, "from", "join"), found(s, NAMED, " table "))

    def bare(s: Column) -> Column:  # without the names of tables that are read or inserted into
        rest = F.when(holds(s, "from", "join"), F.regexp_replace(s, SOURCE, " ")).otherwise(s)
        return F.when(holds(s, "insert"), F.regexp_replace(rest, TARGET, " ")).otherwise(rest)

    def ref(match: Column) -> Column:  # the words of `from name [as] [alias]`, with single spaces
        alias = F.when(F.size(match) > 2, F.element_at(match, -1))
        return F.struct(F.get(match, F.lit(1)).alias("name"), F.when(~alias.isin(*KEYWORDS), alias).alias("alias"))

    c, text = F.col, F.col("text_of")
    base = scripts.withColumn("flat_", flat(F.coalesce("sql", F.lit(""))))
    several = F.filter(F.transform(F.split("flat_", ";"), clean), lambda s: s != "")
    base = base.withColumn("statements", F.when(c("flat_").contains(";"), several).when(clean("flat_") == "", none).otherwise(F.array(clean("flat_"))))
    base = base.withColumn("text_of", F.when(F.size("statements") == 1, F.get("statements", F.lit(0))).otherwise(F.array_join("statements", ";"))).withColumn("apart", (F.size("statements") > 1) & c("text_of").contains("insert"))
    base = base.select(
        *scripts.columns,
        *("statements", "text_of", "apart"),
        each(kind).alias("types"),
        F.array_distinct(found(text, CTE, " as")).alias("cte_names"),
        F.when(c("apart"), each(target)).otherwise(F.array(target(text))).alias("target_of"),
        F.when(c("apart"), each(read)).otherwise(F.array(read(text))).alias("read_of"),
        F.array_distinct(found(text, ALIASED, "from", "join", group=0)).alias("read_as"),
        F.array_distinct(F.when(text.contains("."), extract(bare(text), r"\b\w+\.\w+\b", 0)).otherwise(none)).alias("dotted"),
    )
    first = lambda x: F.get(x, F.lit(0))
    reads = F.when(c("apart"), F.flatten(F.zip_with("read_of", "target_of", F.array_except))).otherwise(F.array_except(first("read_of"), first("target_of")))
    edges = F.flatten(F.zip_with("read_of", "target_of", lambda r, t: F.flatten(F.transform(t, lambda x: F.transform(F.array_except(r, F.array(x)), lambda y: F.struct(y.alias("source"), x.alias("target")))))))
    base = base.withColumn("sources", F.array_sort(F.array_except(reads, "cte_names"))).withColumn("targets", F.array_distinct(F.flatten("target_of")))
    base = base.withColumn("at", F.when(F.size(F.array_remove("types", "insert")) == F.size("types") - 1, F.array_position("types", "insert").cast("int") - 1))
    insert = F.get("statements", c("at"))
    return base.select(
        *scripts.columns,
        F.size("statements").cast("long").alias("statement_count"),
        F.col("types").alias("statement_types"),
        "cte_names",
        "sources",
        F.array_sort("targets").alias("targets"),
        F.array_sort(F.array_union("sources", "targets")).alias("referenced"),
        F.when(c("at").isNotNull(), first(F.get("target_of", c("at")))).alias("insert_target"),
        F.coalesce(insert.contains("partition") & insert.rlike(r"\bpartition\s*\("), F.lit(False)).alias("has_partition"),
        F.array_distinct(F.filter(F.transform("read_as", lambda m: ref(F.split(m, " "))), lambda r: ~F.array_contains("cte_names", r["name"]))).alias("table_refs"),
        F.transform("dotted", lambda x: F.struct(F.substring_index(x, ".", 1).alias("qualifier"), F.substring_index(x, ".", -1).alias("name"))).alias("column_refs"),
        F.array_sort(F.array_distinct(found(text, r"\bas\s+(\w+)", "as "))).alias("select_aliases"),
        F.when(F.size("targets") == 0, F.array().cast("array<struct<source:string,target:string>>")).otherwise(F.array_distinct(F.filter(edges, lambda e: ~F.array_contains("cte_names", e["source"])))).alias("edges"),
        (text.contains("*") & text.rlike(STAR)).alias("has_select_star"),
        F.array_contains("types", "drop").alias("has_drop"),
        F.exists("types", lambda t: t.startswith("truncate")).alias("has_truncate"),
        F.arrays_overlap("types", F.array(*map(F.lit, WRITES))).alias("has_write"),
    )


def facts(scripts: DataFrame, extractor: Callable[[DataFrame], DataFrame] = regex_facts) -> DataFrame:
    """scripts (script_id, mode, sql, ...) with their facts; extractor may be a site's parser (say, a mapInPandas).
    norm is the normalised text, unusable says that it can't be read; a table of facts that is written holds them once
    for all checks."""
    return extractor(scripts).withColumn("norm", normalised_sql("sql")).withColumn("unusable", unusable(F.coalesce("sql", F.lit(""))))


def one_each(found: DataFrame, items: str, name: str) -> DataFrame:
    """found with a row per item of a list column. For explode() Spark infers that the list isn't empty, and moves this filter
    through all steps that make the list: it copies their expressions into it each time, to megabytes. For explode_outer() it doesn't."""
    return found.select("*", F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def unusable(sql: Column) -> Column:
    """Empty text, or quotes or parentheses that don't pair."""
    bare = F.regexp_replace(sql, r"'[^']*'|\"[^\"]*\"", "")
    count = lambda c: F.char_length(bare) - F.char_length(F.replace(bare, F.lit(c), F.lit("")))
    return (clean(sql) == "") | bare.contains("'") | bare.contains('"') | (count("(") != count(")"))


def table_rows(found: DataFrame) -> DataFrame:
    """(script_id, table_name, role, alias): a row per table a script reads or writes."""
    read = found.select("script_id", F.explode("sources").alias("table_name")).distinct().select("script_id", "table_name", F.lit("source").alias("role"))
    wrote = found.select("script_id", F.explode("targets").alias("table_name")).select("script_id", "table_name", F.lit("target").alias("role"))
    alias = found.select("script_id", F.explode("table_refs").alias("r")).filter("r.alias IS NOT NULL").groupBy("script_id", F.col("r.name").alias("table_name")).agg(F.min("r.alias").alias("alias"))
    return read.unionByName(wrote).join(alias, ["script_id", "table_name"], "left")


def column_rows(found: DataFrame) -> DataFrame:
    """(script_id, qualifier, name, is_alias): qualified column references."""
    refs = found.select("script_id", "select_aliases", F.explode("column_refs").alias("c"))
    return refs.select("script_id", "c.qualifier", "c.name", F.array_contains("select_aliases", F.col("c.name")).alias("is_alias"))


def facts_text(found: DataFrame) -> DataFrame:
    """(script_id, text): a script's facts in a fixed order of lines."""
    line = lambda label, x: F.concat(F.lit(label + ": "), F.when(F.size(x) > 0, F.concat_ws(", ", x)).otherwise("none"))
    flag = lambda label, x: F.concat(F.lit(label + ": "), F.when(F.col(x), "yes").otherwise("no"))
    parts = [F.concat(F.lit("statements: "), F.col("statement_count").cast("string")), line("types", "statement_types"), line("sources", "sources"), line("targets", "targets"), line("ctes", "cte_names"), line("aliases", "select_aliases"), flag("select star", "has_select_star"), flag("drop", "has_drop"), flag("truncate", "has_truncate"), flag("writes", "has_write"), flag("partition clause", "has_partition")]
    return found.select("script_id", F.concat_ws("\n", *parts).alias("text"))


def metadata_text(found: DataFrame, columns: DataFrame, description: str = "data_type") -> DataFrame:
    """(script_id, text): for each table that a script reads or writes, the catalog's columns in order, or that it has
    none. Tables are in order of name; a script without tables has no row."""
    names = found.select("script_id", F.explode("referenced").alias("table_name"))
    line = F.concat(F.lit("- "), "name", F.lit(" "), F.coalesce(description, F.lit("")))
    listed = columns.groupBy(F.lower("table_name").alias("known")).agg(F.sort_array(F.collect_list(F.struct("ordinal_position", line.alias("line")))).alias("ls"))
    known = listed.select("known", F.transform("ls", lambda x: x["line"]).alias("ls"))
    rows = names.withColumn("known", F.element_at(F.split("table_name", r"\."), -1))
    rows = lookup(rows, known, ["known"], is_small(columns), "script_id")
    block = F.concat_ws("\n", F.array(F.concat(F.lit("table "), "table_name")), F.coalesce("ls", F.array(F.lit("- not in the catalog"))))
    by = rows.groupBy("script_id").agg(F.sort_array(F.collect_set(F.struct("table_name", block.alias("text")))).alias("ts"))
    return by.select("script_id", F.concat_ws("\n", F.transform("ts", lambda x: x["text"])).alias("text"))
