"""Declared metrics compiled to one grouped aggregation, with guards against adding what can't be added."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from granary.sources.shared import written


@dataclass(frozen=True)
class Metric:
    """expression is a Spark SQL aggregate. A semi-additive one (a balance) may not be added over periods; one that
    isn't additive (a distinct count, a ratio) is computed anew for each total."""

    name: str
    expression: str
    semi_additive: bool = False
    description: str = ""


@dataclass(frozen=True)
class MetricPlan:
    """metrics, group_by and filters (SQL predicates, with ${name} for run parameters); rollup adds the grand total."""

    metrics: tuple[str, ...]
    group_by: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    rollup: bool = False
    params: Mapping[str, str] = field(default_factory=dict)


#: The loan domain's metrics.
LOAN_METRICS = {
    m.name: m
    for m in (
        Metric("loan_balance", "sum(loan_bal_rmb)", True, "Balance in yuan of the reporting period"),
        Metric("enterprise_count", "count(DISTINCT ent_code)", True, "Enterprises with a loan"),
        Metric("weighted_rate", "try_divide(cast(sum(loan_bal_rmb * rate) AS double), cast(sum(loan_bal_rmb) AS double))", True, "Rate weighted by balance"),
    )
}


def declared(metric_rows: Iterable[Mapping[str, object]]) -> dict[str, Metric]:
    """Metrics from rows (name, expression, additive, description), as a semantic model declares them; a metric that isn't declared
    additive may not be added over periods."""
    return {r["name"]: Metric(r["name"], r["expression"], not r.get("additive"), r.get("description") or "") for r in metric_rows}


def checked(metrics: Mapping[str, Metric], facts: DataFrame) -> dict[str, Metric]:
    """The metrics, if each expression is an aggregate of columns that facts have: it is analysed on an empty table of
    their schema, where no row is read. Else an error that names them all."""
    empty, wrong = facts.sparkSession.createDataFrame([], StructType(facts.schema.fields)), []
    for m in metrics.values():
        try:
            if not is_aggregate(empty, m.expression):
                wrong.append(f"{m.name}: not an aggregate: {m.expression}")
        except AnalysisException as e:
            wrong.append(f"{m.name}: {str(e).splitlines()[0]}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return dict(metrics)


def is_aggregate(empty: DataFrame, expression: str) -> bool:
    """Whether an expression folds rows: as a column of a table it gives one row, where a plain one gives none."""
    return empty.select(F.expr(expression).alias("x")).count() == 1


class AdditivityError(ValueError):
    """A plan would add values of different periods."""


def bound(filters: Iterable[str], params: Mapping[str, str]) -> list[str]:
    """Filter texts with their run parameters put in, as what stands in a string literal; one that is missing is an error."""
    out = []
    for f in filters:
        for name, value in params.items():
            f = f.replace("${" + name + "}", value.replace("\\", "\\\\").replace("'", "\\'"))
        if "${" in f:
            raise ValueError(f"no value for a parameter of: {f}")
        out.append(f)
    return out


def one_period(plan: MetricPlan, period: str) -> str | None:
    """The value that a filter sets the period to. The filter must be that equality and nothing else; as filters are
    joined by AND, no other one can add a period."""
    for f in bound(plan.filters, plan.params):
        if m := re.fullmatch(rf"\s*{re.escape(period)}\s*=\s*'([^'\\]*)'\s*", f):
            return m[1]
    return None


def used_columns(plan: MetricPlan, metrics: Mapping[str, Metric] = LOAN_METRICS) -> set[str]:
    """The words of the plan's expressions, which hold the names of the columns that it reads."""
    return set(re.findall(r"\w+", " ".join([*(metrics[m].expression for m in plan.metrics), *plan.filters, *plan.group_by])))


def check_additive(plan: MetricPlan, metrics: Mapping[str, Metric], period: str) -> None:
    """Semi-additive metrics need one period: grouped by it, or a filter of its own that is an equality on it."""
    fixed = one_period(plan, period) is not None
    if any(metrics[m].semi_additive for m in plan.metrics) and not fixed and period not in plan.group_by:
        raise AdditivityError(f"{', '.join(plan.metrics)}: group by {period}, or filter it to one value")
    if plan.rollup and not fixed and any(metrics[m].semi_additive for m in plan.metrics):
        raise AdditivityError(f"a total over {period} would add balances of different periods")


def compile_plan(facts: DataFrame, plan: MetricPlan, metrics: Mapping[str, Metric] = LOAN_METRICS, period: str = "dt", within: Callable[[str], Column] | None = None) -> DataFrame:
    """One pass over facts: metrics are partial and final aggregates. Decimal results are cast to double at the end, so
    that sums are exact. Totals come from rollup over the rows, never from adding groups. Filters on stored columns
    reach the scan by themselves; within gives, for a period that is derived, its condition on a stored column."""
    if missing := [m for m in plan.metrics if m not in metrics]:
        raise ValueError(f"unknown metrics: {missing}")
    check_additive(plan, metrics, period)
    rows = facts
    if within and (value := one_period(plan, period)) is not None:
        rows = rows.filter(within(value))
    if conditions := [F.expr(f) for f in bound(plan.filters, plan.params)]:
        rows = rows.filter(reduce(Column.__and__, conditions))
    aggregates = [F.expr(metrics[m].expression).alias(m) for m in plan.metrics]
    if not plan.group_by:
        out = rows.agg(*aggregates)
    elif plan.rollup:
        out = rows.rollup(*plan.group_by).agg(*aggregates, F.grouping_id().cast("int").alias("is_total"))
    else:
        out = rows.groupBy(*plan.group_by).agg(*aggregates)
    return out.withColumns({f.name: F.col(f.name).cast("double") for f in out.schema if isinstance(f.dataType, DecimalType)})


def period_over_period(facts: DataFrame, metric: Metric, period: str = "dt") -> DataFrame:
    """A metric by month (yyyyMM) beside the month and the year before, and the ratios of change. A window over the
    months' numbers takes the values from one aggregate; its ranges are exact numbers, so that a month that is missing gives
    null, not a wrong neighbour."""
    by = facts.groupBy(period).agg(F.expr(metric.expression).cast("double").alias("value"))
    by = by.withColumn("month", F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 5, 2).cast("int"))
    before = lambda n: F.max("value").over(Window.partitionBy().orderBy("month").rangeBetween(-n, -n))  # noqa: E731, a row per month
    out = by.withColumn("month_before", before(1)).withColumn("year_before", before(12))
    change = lambda x: F.round(F.try_divide(F.col("value") - F.col(x), F.col(x)), 9)
    return out.select(period, "value", "month_before", "year_before", change("month_before").alias("mom"), change("year_before").alias("yoy"))


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(value, number): the distinct values but null, numbered from 0 without gaps: places inside ranges of the values, after the
    counts of the ranges before. Written, as a number must not change."""
    ranged = values.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct().repartitionByRange("value").sortWithinPartitions("value")
    placed = written(ranged.withColumn("row", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("part", F.shiftright("row", 33)).withColumn("at", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return written(placed.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("at")).alias("number")), "numbered")


def distinct_bitmaps(facts: DataFrame, column: str, by: Iterable[str]) -> DataFrame:
    """(by..., bucket, bits), written: which of the numbered values of a column each group has, a bitmap per bucket of
    numbers. Bitmaps of groups can be merged for any total (see distinct_totals); stored, they stand for the facts."""
    keys = list(by)
    rows = facts.select(*keys, F.col(column).alias("value")).distinct()
    coded = rows.join(numbered(facts, column), "value")
    bits = F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits")
    return written(coded.groupBy(*keys, F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(bits), "bitmaps")


def distinct_totals(bitmaps: DataFrame, by: Iterable[str | Column], name: str = "n") -> DataFrame:
    """(by..., n): exact distinct counts of coarser groups, from the union of the bitmaps in each; never a sum of counts."""
    keys = list(by)
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("x"))
    names = [c for c in merged.columns if c not in ("bucket", "x")]
    return merged.groupBy(*names).agg(F.sum("x").alias(name))
