"""The review rules: a registry of native predicates over script facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import has_wide_space, normalised_sql

ALL_MODES = ("debug", "prod", "backfill")
#: How severities and sources rank, and the patterns of two rules (and of their fixes). The rules' ids
#: below are fixed values, too.
SEVERITY = {"high": 3, "medium": 2, "low": 1}
SOURCE = {"rule": 3, "system": 2, "llm": 1}
OVERWRITE = r"\binsert\s++overwrite\s++(?!table\b)"
DATE = r"\b(ds|dt|biz_date|stat_date|pt|partition_date)\s*=\s*(['\"])\d{8}\2"
#: Title, message and suggestion of a rule's issues.
TEXTS = {
    "SELECT_STAR": ("All columns selected", "The select list has a star.", "Name the columns that are needed."),
    "DROP_OR_TRUNCATE": ("Data destroyed", "The script drops or truncates a table.", "Have it confirmed before it runs."),
    "NON_ASCII_WHITESPACE": ("Wide white space", "The text holds white space that isn't ASCII.", "Replace it by plain spaces."),
    "MAXCOMPUTE_INSERT_OVERWRITE_TABLE_REQUIRED": ("TABLE keyword missing", "INSERT OVERWRITE stands without TABLE.", "Write INSERT OVERWRITE TABLE."),
    "DATAWORKS_HARDCODED_DATE": ("Fixed date", "A partition column is compared with a date.", "Use the scheduler's date parameter."),
    "LLM_AGGREGATION_NULL_HANDLING_SUGGESTION": ("Sum over nulls", "A sum has no default for nulls.", "Wrap the column in COALESCE."),
    "LLM_JOIN_DUPLICATION_RISK": ("Join before grouping", "A join stands before GROUP BY and may multiply rows.", "Check the keys of the join."),
    "TABLE_NOT_FOUND": ("Unknown table", "The catalog doesn't have the table.", "Check its name."),
    "COLUMN_NOT_FOUND": ("Unknown column", "The table doesn't have the column.", "Check its name."),
    "METADATA_LOOKUP_FAILED": ("Lookup failed", "The catalog could not be asked.", "Try again later."),
    "INSERT_WITHOUT_PARTITION": ("Partition missing", "The target is partitioned, and the INSERT names no partition.", "Add a PARTITION clause."),
    "INSERT_WITHOUT_PARTITION_METADATA_UNKNOWN": ("Partition may be missing", "Whether the target is partitioned isn't known.", "Check the target."),
    "SQL_PARSE_ERROR": ("Unusable text", "The text can't be read as SQL.", "Correct its quotes and parentheses."),
}


def with_texts(issues: DataFrame, texts: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Issues with title, message and suggestion, by their rule; a rule without texts has its id for all three."""
    for i, name in enumerate(("title", "message", "suggestion")):
        text = F.col("rule_id")
        for rule_id, parts in (texts or TEXTS).items():
            text = F.when(F.col("rule_id") == rule_id, F.lit(parts[i])).otherwise(text)
        issues = issues.withColumn(name, text)
    return issues


def catalog_text(registry: Registry, texts: dict[str, tuple[str, str, str]] | None = None) -> str:
    """The rules as a text, a line each, in the order of registration."""
    said = lambda r: (texts or TEXTS).get(r.rule_id, (r.rule_id,) * 3)
    return "\n".join(f"- {r.rule_id} [{r.severity}, {r.category}, {'/'.join(r.modes)}]: {said(r)[1]}" for r in registry.selected())


def made(x: Column | Callable[[], Column]) -> Column:
    return x if isinstance(x, Column) else x()


def always() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """predicate holds for the scripts with the issue; its columns are those of facts(), and norm, the normalised SQL.
    A column may be given by a function, so that a rule can be declared before there is a session."""

    rule_id: str
    severity: str
    category: str
    predicate: Column | Callable[[], Column]
    evidence: str | Column | Callable[[], Column]
    modes: tuple[str, ...] = ALL_MODES
    action: str = "human_review"
    source: str = "rule"
    confidence: float = 1.0
    auto_fixable: bool = False
    requires_metadata: bool = False
    requires_knowledge: bool = False
    blocking: bool = False
    enabled: bool = True
    table: Column | Callable[[], Column] | None = None
    column: Column | Callable[[], Column] | None = None

    def issue(self) -> Column:
        """The issue as a struct; table_name and column_name say what it is about, null where that isn't one of these."""
        evidence = F.lit(self.evidence) if isinstance(self.evidence, str) else made(self.evidence)
        values = [("rule_id", self.rule_id), ("severity", self.severity), ("category", self.category), ("source", self.source), ("confidence", self.confidence), ("action", self.action), ("auto_fixable", self.auto_fixable), ("requires_metadata", self.requires_metadata), ("requires_knowledge", self.requires_knowledge), ("blocking", self.blocking)]
        about = [F.lit(None).cast("string") if x is None else made(x) for x in (self.table, self.column)]
        return F.struct(*[F.lit(v).alias(k) for k, v in values], evidence.alias("evidence"), about[0].alias("table_name"), about[1].alias("column_name"))


class Registry:
    """Rules in the order of registration. Those that a mode or category leaves out never enter the plan."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self.rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"{rule.rule_id} is registered already")
        self.rules[rule.rule_id] = rule

    def selected(self, categories: Iterable[str] | None = None, mode: str | None = None) -> list[Rule]:
        wanted = None if categories is None else set(categories)
        return [r for r in self.rules.values() if r.enabled and (wanted is None or r.category in wanted) and (mode is None or mode in r.modes)]

    def issues(self, facts: DataFrame, categories: Iterable[str] | None = None, mode: str | None = None) -> DataFrame:
        """(script_id, issue columns): a row per script and rule that it breaks, in the script's mode or the given one."""
        picked = self.selected(categories, mode)
        if not picked:
            return facts.select("script_id", F.explode(F.array(PARSE_ERROR.issue())).alias("x")).filter(F.lit(False)).select("script_id", "x.*")
        rows = facts if "norm" in facts.columns else facts.withColumn("norm", normalised_sql("sql"))
        return rows.select("script_id", F.explode(self.broken(categories, mode)).alias("x")).select("script_id", "x.*")

    def broken(self, categories: Iterable[str] | None = None, mode: str | None = None) -> Column:
        """The issues of a row of facts with norm, as an array."""
        found = [F.when(made(r.predicate) & (F.lit(True) if mode else F.col("mode").isin(*r.modes)), r.issue()) for r in self.selected(categories, mode)]
        return F.array_compact(F.array(*found)) if found else F.filter(F.array(PARSE_ERROR.issue()), lambda x: F.lit(False))


PARSE_ERROR = Rule("SQL_PARSE_ERROR", "high", "syntax", always, lambda: F.substring("sql", 1, 500), action="block", source="system", blocking=True)


def default_registry() -> Registry:
    c, has = F.col, lambda x: F.col("norm").contains(x)
    return Registry(
        [
            Rule("SELECT_STAR", "medium", "style", c("has_select_star"), "select list with *"),
            Rule("DROP_OR_TRUNCATE", "high", "safety", c("has_drop") | c("has_truncate"), "drop or truncate", action="block", blocking=True),
            Rule("NON_ASCII_WHITESPACE", "low", "style", has_wide_space("sql"), "wide white space"),
            Rule("MAXCOMPUTE_INSERT_OVERWRITE_TABLE_REQUIRED", "high", "maxcompute", c("norm").rlike(OVERWRITE), "insert overwrite without table", action="auto_fix", auto_fixable=True),
            Rule("DATAWORKS_HARDCODED_DATE", "medium", "dataworks", c("norm").rlike(DATE), "date literal on a partition column", modes=("debug", "prod")),
            Rule("LLM_AGGREGATION_NULL_HANDLING_SUGGESTION", "medium", "semantic", has("sum(") & ~has("coalesce") & ~has("nvl"), "sum without coalesce", source="llm", confidence=0.7),
            Rule("LLM_JOIN_DUPLICATION_RISK", "medium", "semantic", has(" join ") & has(" group by "), "join then group by", source="llm", confidence=0.65),
        ]
    )
