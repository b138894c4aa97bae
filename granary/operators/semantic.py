"""Semantic models: nested documents of tables, columns and metrics, taken apart into rows and rendered as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """tables array<struct<name:string, description:string, columns:array<struct<name:string, description:string, data_type:string, synonyms:array<string>>>, synonyms:array<string>, grain:string>>,
metrics array<struct<name:string, description:string, expression:string, table:string, synonyms:array<string>>>"""


def load(spark: SparkSession, path: str) -> DataFrame:
    """Models of JSON files, one row each."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def model_of(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Models, a row per table of a catalog, as load() gives them."""
    cells = F.struct("ordinal", F.col("column_name").alias("name"), "description")
    by = columns.groupBy("table_name").agg(F.sort_array(F.collect_list(cells)).alias("cs"))
    cs = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), c["description"].alias("description"), F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("array<string>").alias("synonyms")))
    one = F.struct(F.col("table_name").alias("name"), "description", cs.alias("columns"), F.lit(None).cast("array<string>").alias("synonyms"), F.lit(None).cast("string").alias("grain"))
    return tables.join(by, "table_name", "left").select(F.array(one).alias("tables"))


def table_rows(models: DataFrame) -> DataFrame:
    """(name, description, grain, synonyms, columns); an absent grain is empty text, absent synonyms none."""
    t = models.select(F.explode("tables").alias("t"))
    none = F.array().cast("array<string>")
    return t.select("t.name", F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce("t.grain", F.lit("")).alias("grain"), F.coalesce("t.synonyms", none).alias("synonyms"), "t.columns")


def column_rows(models: DataFrame) -> DataFrame:
    """(table_name, position, name, description, data_type, n_synonyms)."""
    each = models.select(F.explode("tables").alias("t")).select(F.col("t.name").alias("table_name"), F.posexplode("t.columns").alias("position", "c"))
    return each.select("table_name", (F.col("position") + 1).alias("position"), "c.name", F.coalesce("c.description", F.lit("")).alias("description"), F.coalesce("c.data_type", F.lit("")).alias("data_type"), F.coalesce(F.size("c.synonyms"), F.lit(0)).alias("n_synonyms"))


def metric_rows(models: DataFrame) -> DataFrame:
    """(name, description, expression, table): expressions are Spark SQL aggregates."""
    return models.select(F.explode("metrics").alias("m")).select("m.name", F.coalesce("m.description", F.lit("")).alias("description"), "m.expression", "m.table")


def text(models: DataFrame) -> DataFrame:
    """(table_name, text): a table with its columns, in order, for a prompt."""
    line = lambda c: F.concat(F.lit("- "), c["name"], F.when(F.coalesce(c["description"], F.lit("")) != "", F.concat(F.lit(": "), c["description"])).otherwise(""))
    head = F.concat(F.lit("Table "), "name", F.when(F.col("description") != "", F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise(""))
    return table_rows(models).select(F.col("name").alias("table_name"), F.concat_ws("\n", F.array(head), F.transform(F.coalesce("columns", F.array()), line)).alias("text"))
