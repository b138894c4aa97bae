"""Scoring of a system's answers against golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import clean, filter_set, name_set

COMPONENTS = ("table", "metric", "filter", "dimension", "group_by")


def reasons() -> Column:
    """What is wrong with a golden case, as an array."""
    answer, clarify = F.col("expected_behavior") == "answer", F.col("expected_behavior") == "clarify"
    checks = [(clean("case_id") == "", "blank_id"), (clean("question") == "", "blank_question"), (answer & (F.size("expected_tables") == 0), "answer_without_tables"), (clarify & F.col("expected_trusted_sql"), "clarify_with_trusted_sql")]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))


def invalid(golden: DataFrame) -> DataFrame:
    return golden.withColumn("reasons", reasons()).filter(F.size("reasons") > 0)


def valid(golden: DataFrame) -> DataFrame:
    return golden.filter(F.size(reasons()) == 0)


def aligned(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Valid cases with their results. rejected: the result answers another question."""
    a = actual.select("case_id", F.struct(*[c for c in actual.columns if c != "case_id"]).alias("a"))
    rows = valid(golden).join(a, "case_id", "left")
    return rows.withColumn("rejected", F.col("a").isNotNull() & (clean("a.question") != clean("question")))


def rejects(golden: DataFrame, actual: DataFrame) -> DataFrame:
    return aligned(golden, actual).filter("rejected").select("case_id", clean("question").alias("expected_question"), clean("a.question").alias("actual_question"))


def evaluate(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """A row per valid case: behaviour verdict, five component verdicts, pipeline and trusted verdicts, passed.

    A null verdict means that it doesn't apply: components where the answer or the expectation isn't an answer, and all of them for errors.
    A case without a result is an error. Dimensions and groupings count only where the case requires them.
    """
    rows = aligned(golden, actual).filter("NOT rejected")
    behavior = F.coalesce("a.behavior", F.lit("error"))
    rows = rows.withColumn("behavior", behavior)
    both = (F.col("behavior") == "answer") & (F.col("expected_behavior") == "answer")
    same = lambda expected, got, f: F.when(both, f(expected) == f(got))
    rows = rows.select(
        "case_id",
        "expected_behavior",
        "behavior",
        "require_dimension_match",
        "require_group_by_match",
        (F.col("behavior") == F.col("expected_behavior")).alias("behavior_ok"),
        same("expected_tables", "a.tables", name_set).alias("table_ok"),
        same("expected_metrics", "a.metrics", name_set).alias("metric_ok"),
        same("expected_filters", "a.filters", filter_set).alias("filter_ok"),
        same("expected_dimensions", "a.dimensions", name_set).alias("dimension_ok"),
        same("expected_group_by", "a.group_by", name_set).alias("group_by_ok"),
        F.when(F.col("behavior") == "answer", F.coalesce("a.success", F.lit(False))).alias("pipeline_ok"),
        F.when(both, (clean("a.trusted_sql") != "") == F.col("expected_trusted_sql")).alias("trusted_ok"),
    )
    needed = lambda c, on: F.coalesce(F.col(c), F.lit(False)) | ~F.col(on)
    answered = F.col("table_ok") & F.col("metric_ok") & F.col("filter_ok") & needed("dimension_ok", "require_dimension_match") & needed("group_by_ok", "require_group_by_match") & F.col("pipeline_ok") & F.col("trusted_ok")
    passed = F.when(F.col("behavior") == "error", False).when(F.col("behavior") == "clarify", F.col("behavior_ok")).otherwise(F.col("behavior_ok") & F.coalesce(answered, F.lit(False)))
    return rows.withColumn("passed", passed).drop("require_dimension_match", "require_group_by_match")


def failures() -> Column:
    """Failure types of an evaluated row: none if passed, `error` alone for an error, else behaviour and every
    component that is false (not null), in a fixed order."""
    checks = [("behavior_ok", "behavior"), *((f"{c}_ok", c) for c in COMPONENTS), ("pipeline_ok", "pipeline"), ("trusted_ok", "trusted")]
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(True)), None).otherwise(F.lit(n)) for c, n in checks]))
    none = F.array().cast("array<string>")
    return F.when(F.col("passed"), none).when(F.col("behavior") == "error", F.array(F.lit("error"))).otherwise(found)


def histogram(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(F.explode(failures()).alias("failure_type")).groupBy("failure_type").agg(F.count("*").alias("n"))


def summary(evaluated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates: pass and behaviour over all rows, components over the rows that they apply to (0 if none)."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    error = (F.col("behavior") == "error").cast("double")
    measures = [
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed") & (F.col("behavior") != "error")).alias("failed"),
        F.count_if(F.col("behavior") == "error").alias("errors"),
        rate("passed").alias("pass_rate"),
        rate("behavior_ok").alias("behavior_rate"),
        *[rate(f"{c}_ok").alias(f"{c}_rate") for c in (*COMPONENTS, "pipeline", "trusted")],
        F.coalesce(F.avg(error), F.lit(0.0)).alias("error_rate"),
    ]
    return evaluated.groupBy(*by).agg(*measures) if by else evaluated.agg(*measures)
