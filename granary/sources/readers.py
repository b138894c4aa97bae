"""Readers and writers of the library's own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "tables array<struct<name:string, description:string, layer:string, partition_fields:array<string>, columns:array<struct<name:string, data_type:string, description:string, nullable:boolean>>>>"


def scripts(spark: SparkSession, path: str, mode: str = "prod") -> DataFrame:
    """(script_id, path, mode, sql): a row per file, whatever its length; the id is a hash of the path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sql"))
    return rows.select(F.xxhash64("path").alias("script_id"), "path", F.lit(mode).alias("mode"), "sql")


def script_stream(spark: SparkSession, path: str, mode: str = "prod") -> DataFrame:
    """The same for files as they arrive."""
    rows = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sql"))
    return rows.select(F.xxhash64("path").alias("script_id"), "path", F.lit(mode).alias("mode"), "sql")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, name, data_type, ordinal_position, is_partition) of catalog files in JSON; a table without columns
    has one row of nulls."""
    t = spark.read.schema(CATALOG).json(path, multiLine=True).select(F.explode("tables").alias("t"))
    each = t.select("t.name", "t.partition_fields", F.posexplode_outer("t.columns").alias("i", "c"))
    return each.select(F.lower("name").alias("table_name"), F.lower("c.name").alias("name"), "c.data_type", (F.col("i") + 1).alias("ordinal_position"), F.coalesce(F.array_contains("partition_fields", F.col("c.name")), F.lit(False)).alias("is_partition"))


GOLDEN = "case_id string, question string, expected_behavior string, expected_tables array<string>, expected_dimensions array<string>, expected_metrics array<string>, expected_filters array<string>, expected_group_by array<string>, require_dimension_match boolean, require_group_by_match boolean, expected_trusted_sql boolean"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines. What a case leaves out: it expects an answer with trusted SQL, nothing in its lists, and no match
    of dimensions and groupings."""
    rows = spark.read.schema(GOLDEN).json(path)
    defaults = {"expected_behavior": F.lit("answer"), "require_dimension_match": F.lit(False), "require_group_by_match": F.lit(False), "expected_trusted_sql": F.lit(True)}
    empty = F.array().cast("array<string>")
    return rows.select(*[F.coalesce(c, defaults.get(c, empty)).alias(c) if c not in ("case_id", "question") else F.col(c) for c in rows.columns])


def write_fixed(fixed: DataFrame, path: str) -> None:
    """Fixed scripts (script_id, fixed_sql) to a folder of their own, never over the input."""
    fixed.select("script_id", "fixed_sql").write.mode("errorifexists").json(path)


def write_reports(reports: DataFrame, path: str, kind: str = "json") -> None:
    """Reports (script_id, conclusion, report) as JSON rows, their texts alone, or those of report_markdown (kind `markdown`)."""
    if kind == "json":
        reports.write.json(path)
    else:
        reports.select("markdown" if kind == "markdown" else "report").write.text(path)
