"""Contract checks on tables of model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import first_true, joined, json_object

ISSUE_FIELDS = ("rule_id", "title", "severity", "message", "suggestion", "evidence", "category", "confidence")
FIX_FIELDS = ("fixed_sql", "applied_fixes", "manual_notes")


def parsed(outputs: DataFrame) -> DataFrame:
    """outputs (output_id, raw) with obj, the JSON object in raw or null, and its keys."""
    return outputs.withColumn("obj", json_object("raw")).withColumn("keys", F.coalesce(F.json_object_keys("obj"), F.array().cast("array<string>")))


def field(name: str) -> Column:
    return F.get_json_object("obj", f"$.{name}")


def is_text(name: str) -> Column:
    """Whether a field is a string."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("obj"), f"$.{name}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def objects(outputs: DataFrame) -> DataFrame:
    """(output_id, is_object, keys)."""
    return parsed(outputs).select("output_id", F.col("obj").isNotNull().alias("is_object"), joined(F.array_sort("keys")).alias("keys"))


def differences(fields: tuple[str, ...]) -> tuple[Column, Column]:
    """(missing, extra) fields of an object, sorted."""
    wanted = F.array(*map(F.lit, fields))
    return F.array_sort(F.array_except(wanted, "keys")), F.array_sort(F.array_except("keys", wanted))


def issue_items(outputs: DataFrame) -> DataFrame:
    """(output_id, item, raw): the entries of an answer's list of issues, from 0; of an answer without a list none."""
    items = F.from_json(field("issues"), "array<string>")
    return parsed(outputs).select("output_id", F.posexplode(items).alias("item", "raw"))


def envelope_check(outputs: DataFrame) -> DataFrame:
    """(output_id, n_issues, violation): an answer must be an object with a list `issues`."""
    n = F.json_array_length(field("issues")).cast("bigint")
    violation = first_true([(F.col("obj").isNull(), "not_an_object"), (~F.array_contains("keys", "issues"), "missing_issues"), (n.isNull(), "issues_not_a_list")])
    return parsed(outputs).select("output_id", F.coalesce(n, F.lit(0)).alias("n_issues"), violation.alias("violation"))


def issue_check(outputs: DataFrame) -> DataFrame:
    """(output_id, missing, extra, violation): the first rule that an issue object breaks, or null."""
    missing, extra = differences(ISSUE_FIELDS)
    rows = parsed(outputs).withColumn("missing", missing).withColumn("extra", extra)
    score = F.expr("try_cast(get_json_object(obj, '$.confidence') AS double)")
    violation = first_true([(F.col("obj").isNull(), "not_an_object"), (F.size("missing") > 0, "missing_fields"), (F.size("extra") > 0, "extra_fields"), (~F.startswith(F.coalesce(field("rule_id"), F.lit("")), F.lit("LLM_")), "rule_id"), (~F.lower(F.coalesce(field("severity"), F.lit(""))).isin("low", "medium", "high"), "severity"), (score.isNull() | ~score.between(0, 1), "confidence")])
    return rows.select("output_id", joined("missing").alias("missing"), joined("extra").alias("extra"), violation.alias("violation"))


def fix_check(outputs: DataFrame) -> DataFrame:
    """(output_id, n_fixes, n_notes, violation) of fix objects."""
    missing, extra = differences(FIX_FIELDS)
    rows = parsed(outputs).withColumn("missing", missing).withColumn("extra", extra)
    size = lambda n: F.json_array_length(field(n)).cast("bigint")
    violation = first_true([(F.col("obj").isNull(), "not_an_object"), (F.size("missing") > 0, "missing_fields"), (F.size("extra") > 0, "extra_fields"), (~is_text("fixed_sql"), "fixed_sql"), (size("applied_fixes").isNull(), "applied_fixes"), (size("manual_notes").isNull(), "manual_notes")])
    return rows.select("output_id", size("applied_fixes").alias("n_fixes"), size("manual_notes").alias("n_notes"), violation.alias("violation"))


PLAN = "tables array<string>, dimensions array<string>, metrics array<string>, filters array<string>, group_by array<string>, requirements array<string>"


def plan_decode(outputs: DataFrame) -> DataFrame:
    """(output_id, status, question, one column per part of a plan). A ready answer holds a nested plan; an object
    without a status is the plan itself; a part that is absent is empty."""
    rows = parsed(outputs).filter("obj IS NOT NULL").withColumn("root", F.from_json("obj", PLAN)).withColumn("plan", F.from_json(field("plan"), PLAN))
    names = [x.split()[0] for x in PLAN.split(", ")]
    status = F.when(F.lower(field("status")) == "need_clarification", "need_clarification").otherwise("ready")
    asks = status == "need_clarification"
    parts = [joined(F.when(asks, F.array().cast("array<string>")).otherwise(F.coalesce(f"plan.{n}", f"root.{n}", F.array().cast("array<string>")))).alias(n) for n in names]
    return rows.select("output_id", status.alias("status"), F.when(asks, field("question")).alias("question"), *parts)


def verdict_decode(outputs: DataFrame) -> DataFrame:
    """(output_id, status, feedback): verdicts pass, fail and need_clarification; another status is an error. feedback:
    a line per missing requirement, then per issue; a default line for a failure that names none."""
    lists = "missing_requirements array<string>, issues array<string>"
    rows = parsed(outputs).filter("obj IS NOT NULL").withColumn("v", F.from_json("obj", lists)).withColumn("s", F.lower(F.coalesce(field("status"), F.lit(""))))
    status = F.when(F.col("s").isin("pass", "fail", "need_clarification"), F.col("s")).otherwise("error")
    items = lambda c, label: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(label), x))
    lines = F.concat(items("v.missing_requirements", "Missing requirement: "), items("v.issues", "Semantic issue: "))
    feedback = F.when(status == "fail", F.when(F.size(lines) == 0, "The answer does not meet the question.").otherwise(joined(lines))).otherwise("")
    return rows.select("output_id", status.alias("status"), feedback.alias("feedback"))
