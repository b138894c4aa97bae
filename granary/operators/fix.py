"""Automatic fixes, their verification, and the loop that turns scripts into trusted SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import first_true, joined, last_segment, plain_spaces
from granary.operators.catalog import is_small, lookup
from granary.operators.facts import facts as facts_of
from granary.operators.review import hit, in_row, known_tables, resolved, reviewed, routed
from granary.operators.rules import DATE, OVERWRITE, Registry
from granary.sources.shared import written

#: The scheduler's date parameter, the head and the marker of the notes that stay in a script, and the
#: notes' codes.
DATE_PARAMETER = "${bizdate}"
NOTES_HEAD = "-- ================= AI REVIEW TODO ================="
NOTE = "-- AI_REVIEW_TODO: "
PARTITION_NOTES = ("target_unknown", "no_catalog", "lookup_failed", "target_not_found", "not_partitioned", "has_partition", "target_not_located")


def with_table_keyword(sql: Column) -> Column:
    return F.regexp_replace(sql, "(?i)" + OVERWRITE, "insert overwrite table ")


def with_date_parameter(sql: Column) -> Column:
    return F.regexp_replace(sql, "(?i)" + DATE, r"$1 = '\${bizdate}'")


def fix(facts: DataFrame, issues: DataFrame, columns: DataFrame | None) -> DataFrame:
    """(script_id, fixed_sql, applied_fixes, manual_notes) of the scripts that have issues.

    In this order, each only if its issue is present: wide white space, the TABLE keyword, the date parameter, the
    partition clause after the INSERT target (once, named after the catalog's first partition column; else a coded
    note). Issues that need a person become notes, without repeats, in a comment block at the end.
    """
    listed = issues.groupBy("script_id").agg(F.collect_list(F.struct("rule_id", "evidence")).alias("issues"))
    rows = facts.select("script_id", "sql", "insert_target", "has_partition").join(listed, "script_id")
    return fixed(rows, columns).select("script_id", "fixed_sql", "applied_fixes", "manual_notes")


def fixed(rows: DataFrame, columns: DataFrame | None) -> DataFrame:
    """fix() from rows that have a script's sql, insert_target, has_partition and issues (an array, of rule_id and evidence at least): these
    with fixed_sql, applied_fixes and manual_notes, in place of all columns but script_id, mode and sql."""
    kept = [c for c in ("script_id", "mode", "sql") if c in rows.columns]
    flags = {"spaces": "NON_ASCII_WHITESPACE", "keyword": "MAXCOMPUTE_INSERT_OVERWRITE_TABLE_REQUIRED", "date": "DATAWORKS_HARDCODED_DATE", "partition": "INSERT_WITHOUT_PARTITION"}
    noted = lambda r: r.isin("COLUMN_NOT_FOUND", "TABLE_NOT_FOUND", "METADATA_LOOKUP_FAILED") | (r.startswith("LLM_") & (r != "LLM_REVIEW_FAILED"))
    notes = F.transform(F.filter("issues", lambda x: noted(x["rule_id"])), lambda x: F.concat_ws(": ", x["rule_id"], x["evidence"]))
    rows = rows.select(*kept, "insert_target", "has_partition", F.size("issues").alias("n_issues"), F.transform("issues", lambda x: x["rule_id"]).alias("ids"), F.array_sort(F.array_distinct(notes)).alias("notes"))
    rows = rows.withColumns({f"fix_{k}": F.array_contains("ids", r) for k, r in flags.items()})
    known = None if columns is None else in_row(columns)
    if columns is None:
        rows = rows.withColumn("found", F.lit(None).cast("string")).withColumn("status", F.lit("NO_CATALOG")).withColumn("field", F.lit(None).cast("string"))
    elif known is not None:
        entry = hit(known, F.col("insert_target"))
        rows = rows.withColumn("found", entry["found"]).withColumn("field", entry["field"]).withColumn("status", F.lit(""))
    else:
        few = is_small(columns)
        first = columns.filter("is_partition").groupBy(F.lower("table_name").alias("found")).agg(F.min_by("name", "ordinal_position").alias("field"))
        rows = lookup(resolved(rows, "insert_target", known_tables(columns), few), first, ["found"], few, "script_id")
    one = lambda flag, before, after: F.when(F.col(flag), after(F.col(before))).otherwise(F.col(before))
    rows = rows.withColumn("s1", one("fix_spaces", "sql", plain_spaces)).withColumn("s2", one("fix_keyword", "s1", with_table_keyword)).withColumn("s3", one("fix_date", "s2", with_date_parameter))
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    place = F.concat(F.lit(r"(?i)(\binsert\s+(?:overwrite|into)\s+table\s+(?:"), quoted(F.col("insert_target")), F.lit("|"), quoted(last_segment("insert_target")), F.lit(r"))\b"))
    clause = F.concat(F.lit("$1 partition("), F.col("field"), F.lit(r"='\${bizdate}')"))
    able = F.col("fix_partition") & F.col("insert_target").isNotNull() & F.col("field").isNotNull() & ~F.col("has_partition")
    rows = rows.withColumn("s4", F.when(able, F.regexp_replace("s3", place, clause)).otherwise(F.col("s3")))
    why = first_true([(F.col("insert_target").isNull(), PARTITION_NOTES[0]), (F.col("status") == "NO_CATALOG", PARTITION_NOTES[1]), (F.col("status") == "ERROR", PARTITION_NOTES[2]), (F.col("found").isNull(), PARTITION_NOTES[3]), (F.col("field").isNull(), PARTITION_NOTES[4]), (F.col("has_partition"), PARTITION_NOTES[5]), (F.col("s4") == F.col("s3"), PARTITION_NOTES[6])])
    applied = F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.lit(k)) for k, a, b in (("spaces", "sql", "s1"), ("keyword", "s1", "s2"), ("date", "s2", "s3"), ("partition", "s3", "s4"))]))
    notes = F.array_distinct(F.concat(F.array_compact(F.array(F.when(F.col("fix_partition"), F.concat(F.lit("partition: "), why)))), "notes"))
    rows = rows.withColumn("applied_fixes", applied).withColumn("manual_notes", notes)
    block = F.concat_ws("\n", F.array(F.regexp_replace("s4", r"(?U)\s+$", ""), F.lit(""), F.lit(NOTES_HEAD)), F.transform("manual_notes", lambda x: F.concat(F.lit(NOTE), x)), F.array(F.lit("")))
    return rows.select(*kept, "n_issues", F.when(F.size("manual_notes") == 0, F.col("s4")).otherwise(block).alias("fixed_sql"), "applied_fixes", "manual_notes")


def critic(before: DataFrame, fixes: DataFrame, after: DataFrame) -> DataFrame:
    """(script_id, status, passed, need_retry, need_human): the first verdict that holds for a fix.

    before and after: (script_id, success, n_issues); fixes: (script_id, success, fixed_sql, applied_fixes,
    manual_notes). A script without a row in fixes wasn't fixed, one without a row in after wasn't reviewed again."""
    b = before.select("script_id", F.col("n_issues").alias("n_before"))
    a = after.select("script_id", F.col("success").alias("after_success"), F.col("n_issues").alias("n_after"))
    rows = b.join(fixes, "script_id", "left").join(a, "script_id", "left")
    return judged(rows).select("script_id", *VERDICT)


VERDICT = ("status", "passed", "need_retry", "need_human")


def judged(rows: DataFrame) -> DataFrame:
    """rows with their verdict: critic() from a script's success, fixed_sql, applied_fixes, manual_notes, n_before, after_success
    and n_after."""
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    status = first_true(
        [
            (~F.coalesce("success", F.lit(False)), "fix_failed"),
            (F.coalesce("fixed_sql", F.lit("")) == "", "no_fixed_sql"),
            ((F.col("n_before") > 0) & none("applied_fixes"), "no_applied_fixes"),
            (F.col("after_success").isNull(), "re_review_missing"),
            (~F.col("after_success"), "re_review_failed"),
            (F.col("n_after") > 0, "issues_remaining"),
            (~none("manual_notes"), "need_human_confirm"),
        ],
        "passed",
    )
    s = F.col("status")
    return rows.withColumn("status", status).withColumns({"passed": s == "passed", "need_retry": s.isin("re_review_missing", "re_review_failed", "issues_remaining"), "need_human": ~s.isin("passed", "issues_remaining")})


def again(fixes: DataFrame, columns: DataFrame | None, registry: Registry | None = None) -> DataFrame:
    """fixed() rows reviewed again, with the verdict: sql is what the fix made of a script, n_before its issues before that.
    fixes may say by `success` that a script could not be fixed."""
    rows = fixes.select("script_id", "mode", F.col("fixed_sql").alias("sql"), "applied_fixes", "manual_notes", F.col("n_issues").alias("n_before"), "success" if "success" in fixes.columns else F.lit(True).alias("success"))
    rows = reviewed(facts_of(rows), columns, registry)
    return judged(rows.withColumn("fixed_sql", F.col("sql")).withColumn("after_success", ~F.exists("issues", lambda x: x["rule_id"] == "SQL_PARSE_ERROR")).withColumn("n_after", F.size("issues")))


def counted(scripts: DataFrame, issues: DataFrame) -> DataFrame:
    """(script_id, success, n_issues); a script that couldn't be used has no success."""
    by = issues.groupBy("script_id").agg(F.count("*").alias("n"), F.bool_or(F.col("rule_id") == "SQL_PARSE_ERROR").alias("bad"))
    return scripts.select("script_id").join(by, "script_id", "left").select("script_id", (~F.coalesce("bad", F.lit(False))).alias("success"), F.coalesce("n", F.lit(0)).alias("n_issues"))


def trusted(scripts: DataFrame, columns: DataFrame | None, registry: Registry | None = None, max_retries: int = 1) -> DataFrame:
    """(script_id, status, rounds, trusted_sql): review, route, fix, review again, at most max_retries + 1 times.

    Only scripts that a round leaves open enter the next one, with the facts and issues that its verdict was read from. Trusted is the
    text that was fixed and found clean, or the original one where there was nothing to act on; else null."""
    state = ("script_id", "mode", "sql", "insert_target", "has_partition", "route", "final_status")
    brief = F.transform("issues", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["evidence"].alias("evidence"))).alias("issues")
    # A filter of rows that aren't written would have Spark evaluate all that leads to them twice.
    rows = written(routed(reviewed(facts_of(scripts.select("script_id", "mode", "sql")), columns, registry)).select(*state, brief), "routed")
    done: list[DataFrame] = []
    for n in range(1, max_retries + 2):
        ok = F.col("final_status").isin("no_issue", "ignored_issues")
        done.append(rows.filter("route <> 'auto_fix'").select("script_id", F.when(ok & F.lit(n > 1), "fix_verified").otherwise(F.col("final_status")).alias("status"), F.lit(n).alias("rounds"), F.when(ok, F.col("sql")).alias("trusted_sql")))
        # What a fix made of a script is reviewed once: the verdict and the next round read the same table.
        left = written(routed(again(fixed(rows.filter("route = 'auto_fix'"), columns), columns, registry)).select(*state, brief, *VERDICT), "left")
        last = n == max_retries + 1
        closed = left if last else left.filter("NOT need_retry")
        done.append(closed.select("script_id", F.when(F.col("passed"), "fix_verified").otherwise(F.col("status")).alias("status"), F.lit(n).alias("rounds"), F.when(F.col("passed"), F.col("sql")).alias("trusted_sql")))
        rows = left.filter("need_retry").select(*state, "issues")
        if last or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def retry_outcomes(attempts: DataFrame, max_retries: int = 1) -> DataFrame:
    """(thread_id, attempts, used, status) of attempts (thread_id, seq, passed): attempt n is followed by another while
    it failed and n is at most max_retries; the last one allowed decides."""
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("seq"))
    failed_before = F.coalesce(F.max(F.col("passed").cast("int")).over(Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    rows = attempts.withColumn("n", n).withColumn("counts", failed_before & (F.col("n") <= max_retries + 1))
    return rows.groupBy("thread_id").agg(F.count("*").alias("attempts"), F.count_if("counts").alias("used"), F.bool_or(F.col("counts") & F.col("passed")).alias("ok")).select("thread_id", "attempts", "used", F.when(F.col("ok"), "passed").when(F.col("used") > max_retries, "exhausted").otherwise("open").alias("status"))


def flat(fixed: DataFrame) -> DataFrame:
    """fix() with its arrays as texts."""
    return fixed.withColumn("applied_fixes", joined("applied_fixes")).withColumn("manual_notes", joined("manual_notes"))
