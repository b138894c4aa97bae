"""Review of a script corpus: issues, risk, route, the most severe issues, and reports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import first_true, last_segment, name_key, normalised_sql
from granary.operators.catalog import is_small, lookup
from granary.operators.facts import unusable
from granary.operators.rules import PARSE_ERROR, SEVERITY, SOURCE, Registry, Rule, always, default_registry, with_texts
from granary.sources.shared import written

#: A catalog of at most this many columns is a value in the expressions of a script's row.
IN_ROW = 500

TABLE_NOT_FOUND = Rule("TABLE_NOT_FOUND", "high", "metadata", always, lambda: F.col("table_name"), action="block", source="system", blocking=True, table=lambda: F.col("table_name"))
LOOKUP_FAILED = Rule("METADATA_LOOKUP_FAILED", "medium", "metadata", always, lambda: F.col("table_name"), action="context_required", source="system", requires_metadata=True, table=lambda: F.col("table_name"))
COLUMN_NOT_FOUND = Rule("COLUMN_NOT_FOUND", "high", "metadata", always, lambda: F.concat_ws(".", "qualifier", "name"), action="block", source="system", blocking=True, table=lambda: F.col("owner"), column=lambda: F.col("name"))
NO_PARTITION = Rule("INSERT_WITHOUT_PARTITION", "high", "metadata", always, lambda: F.col("insert_target"), table=lambda: F.col("insert_target"))
PARTITION_UNKNOWN = Rule("INSERT_WITHOUT_PARTITION_METADATA_UNKNOWN", "medium", "metadata", always, lambda: F.col("insert_target"), table=lambda: F.col("insert_target"))


def raised(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.select("script_id", rule.issue().alias("x")).select("script_id", "x.*")


def resolved(refs: DataFrame, name: str, known: DataFrame, few: bool | None = None) -> DataFrame:
    """refs with `found`: the catalog's name of a table, by its full name or else its last segment. known: (table_name,
    status), where status ERROR says that the lookup failed. refs have a script_id. few: whether the catalog is small enough to broadcast;
    here and below it is counted if that isn't told."""
    few = is_small(known) if few is None else few
    keys = known.select(F.lower("table_name").alias("key"), F.struct(F.col("table_name").alias("hit"), "status").alias("by"))
    keyed = refs.withColumn("whole", name_key(name)).withColumn("short", last_segment(name_key(name)))
    if few:
        both = lambda c: F.broadcast(keys.select(F.col("key").alias(c), F.col("by").alias(f"by_{c}")))
        out = keyed.join(both("whole"), "whole", "left").join(both("short"), "short", "left").withColumn("by", F.coalesce("by_whole", "by_short"))
    else:  # Each name once meets the catalog, in one join; the rows then meet the names.
        tries = keyed.select("whole", "short").distinct().select("whole", F.posexplode(F.array_distinct(F.array("whole", "short"))).alias("at", "key"))
        out = lookup(keyed, tries.join(keys, "key").groupBy("whole").agg(F.min_by("by", "at").alias("by")), ["whole"], few, "script_id")
    out = out.withColumn("found", F.col("by.hit")).withColumn("status", F.coalesce("by.status", F.lit("NOT_FOUND")))
    return out.drop("whole", "short", "by_whole", "by_short", "by")


def known_tables(columns: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(table_name, status) of a catalog's columns, and of tables whose lookup failed (table_name)."""
    known = columns.select(F.lower("table_name").alias("table_name")).distinct().withColumn("status", F.lit("FOUND"))
    return known if failed is None else known.unionByName(failed.select(F.lower("table_name").alias("table_name"), F.lit("ERROR").alias("status")))


def table_issues(facts: DataFrame, known: DataFrame, few: bool | None = None) -> DataFrame:
    """Tables without a catalog entry, and those whose lookup failed (which says nothing about whether they exist)."""
    refs = resolved(facts.select("script_id", F.explode("referenced").alias("table_name")), "table_name", known, few)
    issue = F.when(F.col("status") == "NOT_FOUND", TABLE_NOT_FOUND.issue()).when(F.col("status") == "ERROR", LOOKUP_FAILED.issue())
    return refs.select("script_id", issue.alias("x")).filter("x IS NOT NULL").select("script_id", "x.*")


def column_issues(facts: DataFrame, columns: DataFrame, few: bool | None = None) -> DataFrame:
    """Qualified columns that their table lacks. A qualifier is a table's full or short name or alias; one that is a
    common table expression, or that no found table has, is skipped; so is a column named like a select alias. A column
    without a qualifier (a parser may supply such) belongs to the script's source table if there is just
    one, and no common table expression."""
    few = is_small(columns) if few is None else few
    known = known_tables(columns)
    refs = facts.select("script_id", F.explode("table_refs").alias("r")).select("script_id", "r.name", "r.alias")
    named = resolved(refs, "name", known, few).filter("status = 'FOUND'")
    keys = F.array_distinct(F.array_compact(F.array("name", last_segment("name"), "alias")))
    owners = named.select("script_id", F.explode(keys).alias("qualifier"), F.col("found").alias("owner")).distinct()
    only = F.when((F.size("sources") == 1) & (F.size("cte_names") == 0), F.element_at("sources", 1))
    used = facts.select("script_id", "select_aliases", "cte_names", only.alias("only"), F.explode("column_refs").alias("c"))
    if "table" in used.schema["c"].dataType.fieldNames():  # resolved by scopes: a table or nothing
        used = used.withColumn("place", F.col("c.table"))
    else:
        used = used.withColumn("place", F.coalesce("c.qualifier", "only"))
    used = used.filter(~F.array_contains("select_aliases", F.col("c.name")) & ~F.array_contains("cte_names", F.col("place")))
    placed = used.select("script_id", "place", "c.qualifier", "c.name").join(owners.withColumnRenamed("qualifier", "place"), ["script_id", "place"])
    have = columns.select(F.lower("table_name").alias("owner"), F.lower("name").alias("name")).distinct()
    lacking = lookup(placed, have, ["owner", "name"], few, "script_id", "left_anti")
    return raised(lacking.groupBy("script_id", "qualifier", "name").agg(F.min("owner").alias("owner")), COLUMN_NOT_FOUND)


def with_partitions(facts: DataFrame, columns: DataFrame | None, few: bool | None = None) -> DataFrame:
    """facts with `partitioned`: whether the catalog says so of the single INSERT's target; null if it doesn't have it."""
    if columns is None:
        return facts.withColumn("partitioned", F.lit(None).cast("boolean"))
    few = is_small(columns) if few is None else few
    parts = columns.groupBy(F.lower("table_name").alias("found")).agg(F.bool_or("is_partition").alias("partitioned"))
    return lookup(resolved(facts, "insert_target", known_tables(columns), few), parts, ["found"], few, "script_id").drop("found", "status")


def partition_issue(unknown: bool) -> Column:
    """Of a row with_partitions, as an array: an INSERT without a PARTITION clause into a partitioned table, or into one
    that may be, where there is no catalog; a target that the catalog doesn't have is silent here."""
    lacks = F.col("insert_target").isNotNull() & ~F.col("has_partition")
    return F.array_compact(F.array(F.when(lacks, PARTITION_UNKNOWN.issue()) if unknown else F.when(lacks & F.col("partitioned"), NO_PARTITION.issue())))


def partition_issues(facts: DataFrame, columns: DataFrame | None, few: bool | None = None) -> DataFrame:
    rows = with_partitions(facts, columns, few)
    return rows.select("script_id", F.explode(partition_issue(columns is None)).alias("x")).select("script_id", "x.*")


def in_row(columns: DataFrame) -> Column | None:
    """The catalog as a value: a map by a table's name in lower case, of that name (found), its columns' names, whether it
    is partitioned, and its first partition column (field). None if it has more columns than IN_ROW."""
    ordinal = "ordinal_position" if "ordinal_position" in columns.columns else F.lit(None).alias("ordinal_position")
    rows = columns.select(F.lower("table_name").alias("table"), F.lower("name").alias("low"), "name", "is_partition", ordinal).filter("table IS NOT NULL").limit(IN_ROW + 1).collect()
    if len(rows) > IN_ROW:
        return None
    text = lambda x: F.lit(x).cast("string")
    pairs: list[Column] = []
    for name in dict.fromkeys(r.table for r in rows):
        mine = [r for r in rows if r.table == name]
        told = [r.is_partition for r in mine if r.is_partition is not None]
        fields = [(r.ordinal_position, r.name) for r in mine if r.is_partition and r.ordinal_position is not None]
        names = F.array(*[text(x) for x in dict.fromkeys(r.low for r in mine if r.low is not None)]).cast("array<string>")
        pairs += [F.lit(name), F.struct(text(name).alias("found"), names.alias("names"), F.lit(any(told) if told else None).cast("boolean").alias("partitioned"), text(min(fields, key=lambda x: x[0])[1] if fields else None).alias("field"))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,struct<found:string,names:array<string>,partitioned:boolean,field:string>>")


def hit(known: Column, name: Column) -> Column:
    """A table's entry in a catalog in_row: by its full name, or else its last segment; null if it has none."""
    key = name_key(name)
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, last_segment(key)))


def found_in_row(facts: DataFrame, known: Column) -> tuple[DataFrame, list[Column]]:
    """The checks of table_issues, column_issues and partition_issues from a script's row: facts with the columns that they
    need, and their arrays of issues."""
    empty = lambda c: F.coalesce(c, F.array().cast(facts.schema[c].dataType))
    tables = F.transform(F.filter(empty("referenced"), lambda x: hit(known, x).isNull()), lambda x: replace(TABLE_NOT_FOUND, evidence=x, table=x).issue())
    named = F.filter(F.transform(empty("table_refs"), lambda r: F.struct(r["name"].alias("name"), r["alias"].alias("alias"), hit(known, r["name"])["found"].alias("owner"))), lambda r: r["owner"].isNotNull())
    keys = lambda r: F.array_distinct(F.array_compact(F.array(r["name"], last_segment(r["name"]), r["alias"])))
    owners = F.flatten(F.transform(named, lambda r: F.transform(keys(r), lambda q: F.struct(q.alias("place"), r["owner"].alias("owner")))))
    only = F.when((F.size("sources") == 1) & (F.size("cte_names") == 0), F.element_at("sources", 1))
    scoped = "table" in facts.schema["column_refs"].dataType.elementType.fieldNames()  # resolved by scopes: a table or nothing
    place = lambda c: c["table"] if scoped else F.coalesce(c["qualifier"], "only_")
    used = F.filter(empty("column_refs"), lambda c: ~F.array_contains("select_aliases", c["name"]) & ~F.array_contains("cte_names", place(c)))
    lacks = lambda c, o: (o["place"] == place(c)) & ~F.coalesce(F.array_contains(F.try_element_at(known, o["owner"])["names"], c["name"]), F.lit(False))
    lacking = F.flatten(F.transform(used, lambda c: F.transform(F.filter("owners_", lambda o: lacks(c, o)), lambda o: F.struct(c["qualifier"].alias("qualifier"), c["name"].alias("name"), o["owner"].alias("owner")))))
    rows = facts.withColumn("partitioned", hit(known, F.col("insert_target"))["partitioned"]).withColumn("owners_", owners).withColumn("only_", only)
    rows = rows.withColumn("lacking_", F.when(F.size("owners_") > 0, F.array_sort(F.array_distinct(lacking))))
    same = lambda x, y: x["qualifier"].eqNullSafe(y["qualifier"]) & (x["name"] == y["name"])
    first = F.filter(F.coalesce("lacking_", F.array().cast(rows.schema["lacking_"].dataType)), lambda x, i: (i == 0) | ~same(x, F.get("lacking_", i - 1)))
    columns = F.transform(first, lambda x: replace(COLUMN_NOT_FOUND, evidence=F.concat_ws(".", x["qualifier"], x["name"]), table=x["owner"], column=x["name"]).issue())
    return rows, [tables, columns]


def reviewed(facts: DataFrame, columns: DataFrame | None, registry: Registry | None = None, categories: Iterable[str] | None = None, mode: str | None = None) -> DataFrame:
    """facts with `issues`, the array of a script's issues as review() raises them.

    A catalog that is small enough is looked up in the script's row, so that nothing is shuffled; a larger one is met by joins."""
    known = None if columns is None else in_row(columns)
    if columns is not None and known is None:
        facts = written(facts, "facts")
        issues = by_joins(facts, columns, registry, categories, mode)
        listed = issues.groupBy("script_id").agg(F.collect_list(F.struct(*issues.columns[1:])).alias("issues"))
        return facts.join(listed, "script_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)))
    return in_rows(facts, known, registry, categories, mode)


def with_text(facts: DataFrame) -> DataFrame:
    """facts with unusable and norm, if these aren't there."""
    if "unusable" not in facts.columns:
        facts = facts.withColumn("unusable", unusable(F.coalesce("sql", F.lit(""))))
    return facts if "norm" in facts.columns else facts.withColumn("norm", normalised_sql("sql"))


def in_rows(facts: DataFrame, known: Column | None, registry: Registry | None, categories: Iterable[str] | None, mode: str | None) -> DataFrame:
    rows, more = with_text(facts), []
    if known is None:
        rows = with_partitions(rows, None)
    else:
        rows, more = found_in_row(rows, known)
    own = [(registry or default_registry()).broken(categories, mode), partition_issue(known is None), *more]
    rows = rows.withColumn("issues", F.when(F.col("unusable"), F.array(PARSE_ERROR.issue())).otherwise(F.concat(*own)))
    return rows.drop("partitioned", "owners_", "only_", "lacking_")


def review(facts: DataFrame, columns: DataFrame | None, registry: Registry | None = None, categories: Iterable[str] | None = None, mode: str | None = None) -> DataFrame:
    """All issues of all scripts: (script_id, issue columns). A script that can't be used has one issue, of that. The
    catalog's checks don't heed the category filter. What a script's own row tells is raised in one scan."""
    known = None if columns is None else in_row(columns)
    if columns is not None and known is None:
        return by_joins(facts, columns, registry, categories, mode)
    # explode would have Spark find out first, by a second evaluation, whether there are any.
    rows = in_rows(facts, known, registry, categories, mode).select("script_id", F.explode_outer("issues").alias("x"))
    return rows.filter("x IS NOT NULL").select("script_id", "x.*")


def by_joins(facts: DataFrame, columns: DataFrame, registry: Registry | None, categories: Iterable[str] | None, mode: str | None) -> DataFrame:
    """review() against a catalog that is met by joins."""
    facts = with_text(facts)
    few = is_small(columns)
    rows = with_partitions(facts, columns, few)
    own = F.when(F.col("unusable"), F.array(PARSE_ERROR.issue())).otherwise(F.concat((registry or default_registry()).broken(categories, mode), partition_issue(False)))
    found = rows.select("script_id", F.explode(own).alias("x")).select("script_id", "x.*")
    good = facts.filter("NOT unusable")
    return found.unionByName(table_issues(good, known_tables(columns), few)).unionByName(column_issues(good, columns, few))


def rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def risk(scripts: DataFrame, issues: DataFrame) -> DataFrame:
    """(script_id, risk_level, n_issues, n_high, n_medium, n_low); low also where there is no issue."""
    counts = issues.groupBy("script_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY])
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c if c != "n" else "n_issues")
    level = first_true([(F.col("n_high") > 0, "high"), (F.col("n_medium") > 0, "medium")], "low")
    return scripts.select("script_id").join(counts, "script_id", "left").select("script_id", level.alias("risk_level"), n("n"), n("n_high"), n("n_medium"), n("n_low"))


def top_risks(issues: DataFrame, limit: int = 5) -> DataFrame:
    """A script's first issues: by severity, then source, then rule, then evidence."""
    order = Window.partitionBy("script_id").orderBy(rank("severity", SEVERITY).desc(), rank("source", SOURCE).desc(), "rule_id", "evidence")
    return issues.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("script_id", "position", "rule_id", "severity", "source", "evidence")


def route(scripts: DataFrame, issues: DataFrame) -> DataFrame:
    """(script_id, route, final_status, n_actionable): the first rule that holds for a script's issues."""
    acts = F.col("action") != "ignore"
    any_of = lambda c: F.coalesce(F.bool_or(acts & c), F.lit(False))
    by = issues.groupBy("script_id").agg(
        F.count("*").alias("n"),
        F.count_if(acts).alias("n_actionable"),
        any_of(F.col("blocking") | (F.col("action") == "block")).alias("blocks"),
        any_of(F.col("requires_metadata")).alias("meta"),
        any_of(F.col("requires_knowledge")).alias("know"),
        any_of(F.col("action") == "context_required").alias("context"),
        F.bool_and(~acts | ((F.col("action") == "auto_fix") & F.col("auto_fixable"))).alias("fixable"),
    )
    rows = scripts.select("script_id").join(by, "script_id", "left").withColumn("n_actionable", F.coalesce("n_actionable", F.lit(0)))
    route, status = routes()
    return rows.select("script_id", route.alias("route"), status.alias("final_status"), "n_actionable")


def routed(rows: DataFrame) -> DataFrame:
    """reviewed() rows with route and final_status, as route() finds them."""
    any_of = lambda c: F.exists("issues", lambda x: (x["action"] != "ignore") & c(x))
    out = rows.withColumns(
        {
            "n": F.when(F.size("issues") > 0, F.size("issues")),
            "n_actionable": F.size(F.filter("issues", lambda x: x["action"] != "ignore")),
            "blocks": any_of(lambda x: x["blocking"] | (x["action"] == "block")),
            "meta": any_of(lambda x: x["requires_metadata"]),
            "know": any_of(lambda x: x["requires_knowledge"]),
            "context": any_of(lambda x: x["action"] == "context_required"),
            "fixable": F.forall("issues", lambda x: (x["action"] == "ignore") | ((x["action"] == "auto_fix") & x["auto_fixable"])),
        }
    )
    route, status = routes()
    return out.withColumn("route", route).withColumn("final_status", status).drop("n", "n_actionable", "blocks", "meta", "know", "context", "fixable")


def routes() -> tuple[Column, Column]:
    """(route, final status) from what a script's issues have in common."""
    none = F.col("n_actionable") == 0
    cases = [(none & F.col("n").isNull(), "complete", "no_issue"), (none, "complete", "ignored_issues"), (F.col("blocks"), "block", "blocked"), (F.col("meta") & F.col("know"), "context_required", "metadata&knowledge_required"), (F.col("meta"), "metadata_required", "metadata_required"), (F.col("know"), "knowledge_required", "knowledge_required"), (F.col("context"), "context_required", "context_required"), (F.col("fixable"), "auto_fix", None)]
    status = F.lit("need_human_confirm")
    for c, _, s in reversed(cases):
        status = F.when(c, F.lit(s)).otherwise(status)
    return first_true([(c, r) for c, r, _ in cases], "human_review"), status


def report(scripts: DataFrame, issues: DataFrame, limit: int = 5) -> DataFrame:
    """(script_id, conclusion, report): a text per script, with its most severe issues in order."""
    lines = F.sort_array(F.collect_list(F.struct("position", F.format_string("%d. [%s] %s: %s", "position", "severity", "rule_id", F.coalesce("evidence", F.lit(""))).alias("line"))))
    listed = top_risks(issues, limit).groupBy("script_id").agg(lines.alias("lines")).select("script_id", F.transform("lines", lambda x: x["line"]).alias("lines"))
    rows = risk(scripts, issues).join(listed, "script_id", "left")
    conclusion = first_true([(F.col("n_issues") == 0, "no issue found"), (F.col("risk_level") == "high", "not fit for release"), (F.col("risk_level") == "medium", "to be confirmed before release")], "minor issues only")
    head = F.format_string("risk %s, %d issues (%d high, %d medium, %d low)", "risk_level", "n_issues", "n_high", "n_medium", "n_low")
    return rows.select("script_id", conclusion.alias("conclusion"), F.concat_ws("\n", F.array(head), F.coalesce("lines", F.array().cast("array<string>"))).alias("report"))


def report_markdown(scripts: DataFrame, issues: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(script_id, markdown): a report with every issue's texts in order of severity, source, rule and evidence, then
    the fixed SQL of scripts that have one in fixed (script_id, fixed_sql, applied_fixes, manual_notes)."""
    told = with_texts(issues)
    code = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("`"))
    body = F.concat_ws("\n", F.concat(F.lit("- Rule: "), code("rule_id")), F.concat(F.lit("- Severity: "), code("severity")), F.concat(F.lit("- Source: "), code("source")), F.lit(""), "message", F.lit(""), "suggestion", F.lit(""), F.lit("```text"), F.coalesce("evidence", F.lit("")), F.lit("```"))
    by_rank = F.struct((-rank("severity", SEVERITY)).alias("a"), (-rank("source", SOURCE)).alias("b"), "rule_id", F.coalesce("evidence", F.lit("")).alias("evidence"), F.col("title"), body.alias("body"))
    listed = told.groupBy("script_id").agg(F.sort_array(F.collect_list(by_rank)).alias("xs"))
    parts = F.transform("xs", lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n\n"), x["body"]))
    rows = report(scripts, issues).join(listed.select("script_id", parts.alias("parts")), "script_id", "left")
    head = F.concat(F.lit("# SQL Review Report\n\n"), F.col("conclusion"), F.lit("\n\n"), F.element_at(F.split("report", "\n"), 1), F.lit("\n\n## Issue Details"))
    sections = F.concat(F.array(head), F.coalesce("parts", F.array(F.lit("No issue found."))))
    if fixed is not None:
        rows = rows.join(fixed.select("script_id", "fixed_sql", "applied_fixes", "manual_notes"), "script_id", "left")
        items = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"### {label}\n\n"), F.concat_ws("\n", F.transform(c, lambda x: F.concat(F.lit("- "), x)))))
        sql = F.concat(F.lit("### Fixed SQL\n\n```sql\n"), F.regexp_replace("fixed_sql", r"(?U)\s+$", ""), F.lit("\n```"))
        sections = F.concat(sections, F.when(F.col("fixed_sql").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.lit("## Fixed SQL"), items("Applied Fixes", "applied_fixes"), items("Manual Review Notes", "manual_notes"), sql))))
    return rows.select("script_id", F.concat_ws("\n\n", sections).alias("markdown"))
