"""The library's canonical inputs, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_month(value: str) -> Column:
    """A month (yyyyMM) as a range of the day that loan_snapshot keeps, which reaches the scan."""
    first = F.to_timestamp(F.lit(f"{value}01"), "yyyyMMdd")
    return (F.col("day") >= first) & (F.col("day") < F.add_months(first, 1).cast("timestamp"))


def loan_snapshot(spark: SparkSession, sf_dir: str, used: set[str] | None = None) -> DataFrame:
    """A loan per line item: one row per loan and reporting month. Suppliers and nations are joined as Spark finds best;
    with the names of used columns, only the tables are joined that have one of them."""
    t = lambda name: table(spark, sf_dir, name)
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("fin_org_branch_area_code"))
    who = t("orders").select("o_orderkey", F.col("o_custkey").alias("ent_code"), F.col("o_orderpriority").alias("fin_org_type_code"))
    kind = t("part").select("p_partkey", F.col("p_type").alias("green_loan_type_code"))
    rows = t("lineitem")
    for other, left, right in ((who, "l_orderkey", "o_orderkey"), (place, "l_suppkey", "s_suppkey"), (kind, "l_partkey", "p_partkey")):
        if used is None or used & set(other.columns):
            rows = rows.join(other, F.col(left) == F.col(right))
    flag = lambda c: F.when(c, "1").otherwise("0")
    joined = [c for c in ("ent_code", "fin_org_branch_area_code", "fin_org_type_code", "green_loan_type_code") if c in rows.columns]
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("loan_iou_no"),
        F.col("l_shipdate").alias("day"),
        *joined,
        F.col("l_extendedprice").cast("decimal(22,2)").alias("loan_bal_rmb"),
        F.col("l_discount").cast("decimal(15,5)").alias("rate"),
        F.date_format("l_shipdate", "yyyyMM").alias("dt"),
        flag(F.col("l_returnflag") == "R").alias("is_high_tech_mfg_loan_code"),
        flag(F.col("l_linestatus") == "F").alias("is_sci_medium_ent_loan_code"),
    )


def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data dictionary from the parts: real repeats and ties, with blanks, case and outer white space as in sheets."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    number = F.regexp_extract("p_brand", r"\d+", 0).cast("int")
    prefix = F.element_at(F.array(*map(F.lit, ("dwd", "dwd", "DWD", "ods", "ads", "tmp"))), (number % 6 + 1).cast("int"))
    brand = F.lower(F.regexp_replace("p_brand", "#", ""))
    return p.select(
        key.alias("row_no"),
        F.when(key % 97 == 5, None).when(key % 89 == 7, "  ").otherwise(F.concat(F.lit(" "), prefix, F.lit("_"), brand)).alias("table_name"),
        F.when(key % 101 == 3, None).otherwise(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("\t"))).alias("column_name"),
        F.when(key % 11 == 0, None).otherwise(F.lower("p_type")).alias("table_desc"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.col("p_type"), F.lit(" "), F.split("p_name", " ")[0])).alias("column_desc"),
    )


#: The physical tables that scripts may name: columns as `name type`, `!` for a partition column.
CATALOG = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "ads_order_summary": "user_id bigint, order_count bigint, order_amount decimal(18;2), dt string!",
}


def catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of CATALOG."""
    columns = [(t, *c.strip().rstrip("!").replace(";", ",").split(" ", 1), i + 1, c.endswith("!")) for t, cs in CATALOG.items() for i, c in enumerate(cs.split(", "))]
    rows = lambda values, names: spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in values])))
    return rows([(t, f"table {t}") for t in CATALOG], ("full_name", "description")), rows(columns, ("table_name", "name", "data_type", "ordinal_position", "is_partition"))


SCRIPTS = (
    "SELECT * FROM orders WHERE o_custkey = {c}",
    "SELECT COUNT(*) AS n FROM lineitem",
    "INSERT OVERWRITE ads_order_summary SELECT o.o_custkey FROM orders o",
    "INSERT OVERWRITE TABLE ads_order_summary SELECT o.o_custkey FROM orders o WHERE dt = '{d}'",
    "DROP TABLE tmp_{c}",
    "SELECT o.o_custkey, SUM(l.l_extendedprice) AS amt FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey",
    "WITH r AS (SELECT o_custkey FROM orders) SELECT r.o_custkey, c.c_name FROM r JOIN customer c ON r.o_custkey = c.c_custkey",
    "SELECT o.o_amout FROM orders o",
    "SELECT user_id FROM dwd_missing_order",
    "SELECT　o_custkey FROM orders",
    "-- select * from x\nSELECT o_orderkey FROM orders /* drop table y */",
    "TRUNCATE TABLE stage_{c}",
    "INSERT INTO TABLE ads_order_summary PARTITION (dt='${bizdate}') SELECT o.o_custkey FROM orders o",
    "INSERT INTO ads_order_summary SELECT l.l_orderkey FROM lineitem l; SELECT s.user_id FROM ads_order_summary s",
    "INSERT OVERWRITE customer SELECT o.o_custkey FROM orders o",
    "INSERT INTO TABLE stage_{c} SELECT x.k FROM stage_{h} x",
    "INSERT OVERWRITE customer SELECT o.o_custkey FROM orders o; INSERT /* again */ OVERWRITE customer SELECT c.c_custkey FROM customer c",
)
MODES = ("prod", "debug", "backfill")


def sql_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script_id, path, mode, sql): a script per order, of one of the templates. What is done to texts costs far more than to read
    orders, so that these are dealt to all cores first, however few row groups their files have."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod("o_orderkey", F.lit(n)) + 1).cast("int"))
    values = {"{c}": F.col("o_custkey").cast("string"), "{h}": F.floor(F.col("o_custkey") / 2).cast("string"), "{d}": F.date_format("o_orderdate", "yyyyMMdd")}
    sql = pick(SCRIPTS, len(SCRIPTS))
    for name, value in values.items():
        sql = F.replace(sql, F.lit(name), value)
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.pmod("o_custkey", F.lit(3)) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("script_id"), F.format_string("/scripts/%d.sql", "o_orderkey").alias("path"), mode.alias("mode"), sql.alias("sql"))


#: Scripts with comma joins, names in backticks, nested expressions and aliases that inner queries use again.
NESTED = (
    "SELECT x.a{a}, y.b{b} FROM t{a} x, `Db`.`T{b}` y WHERE x.k = y.k",
    "WITH c{a} AS (SELECT x.v FROM t{a} x), e AS (WITH c{a} AS (SELECT z.w FROM t{b} z) SELECT c{a}.w FROM c{a}) SELECT c{a}.v, e.w FROM c{a}, e, t{d}",
    "SELECT o.a, (SELECT max(o.v) FROM t{b} o WHERE o.k = p.k) AS m FROM t{a} o JOIN t{d} p ON o.k = p.k",
    "INSERT OVERWRITE TABLE out{a} SELECT s.k FROM (SELECT q.k FROM t{b} q, t{d}) s -- from none\nWHERE s.n = 'from t0, t1'",
    "SELECT x.a FROM t{a} AS x LEFT JOIN t{b} AS y ON x.k = y.k AND y.z IN (SELECT w.z FROM t{d} w), t7 GROUP BY x.a; SELECT t{b}.k FROM t{b}",
)


def nested_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script_id, mode, sql): a script per order, of one of NESTED, over 5,000 tables."""
    o = table(spark, sf_dir, "orders")
    sql = F.element_at(F.array(*map(F.lit, NESTED)), (F.pmod("o_orderkey", F.lit(len(NESTED))) + 1).cast("int"))
    for name, number in (("{a}", F.col("o_orderkey")), ("{b}", F.col("o_custkey")), ("{d}", F.col("o_orderkey") + 7)):
        sql = F.replace(sql, F.lit(name), F.pmod(number, F.lit(5000)).cast("string"))
    return o.select(F.col("o_orderkey").alias("script_id"), F.lit("prod").alias("mode"), sql.alias("sql"))


def wide_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the tables that nested_scripts name, but for those that it lacks."""
    n = F.pmod("o_orderkey", F.lit(5000))
    number = table(spark, sf_dir, "orders").select(n.alias("n")).distinct()
    has = lambda name, unless=False, part=False: F.when(~F.lit(unless) if isinstance(unless, bool) else ~unless, F.struct(name.alias("name"), F.lit(part).alias("is_partition")))
    k, own = F.lit("k"), F.concat(F.lit("A"), F.col("n").cast("string"))
    read = F.array_compact(F.array(has(own), has(k, F.col("n") % 7 == 2), has(F.lit("v"), F.col("n") % 2 == 1), has(F.lit("z")), has(F.lit("w"), F.col("n") % 5 == 3)))
    wrote = F.array_compact(F.array(has(k), has(F.lit("dt"), F.col("n") % 4 != 0, True)))
    tables = number.filter("n % 11 <> 3").select(F.format_string("T%d", "n").alias("table_name"), read.alias("cs")).unionByName(number.filter("n % 3 <> 1").select(F.format_string("out%d", "n").alias("table_name"), wrote.alias("cs")))
    return tables.select("table_name", F.posexplode("cs").alias("at", "c")).select("table_name", "c.name", F.lit("string").alias("data_type"), (F.col("at") + 1).alias("ordinal_position"), "c.is_partition")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, kind, text): whole texts; a third of them verified SQL."""
    kind = F.when(F.col("doc_id") % 3 == 0, "verified_sql").otherwise("business_knowledge")
    return table(spark, sf_dir, "documents").select(F.format_string("doc-%012d", "doc_id").alias("document_id"), kind.alias("kind"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected plans, a case per order."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lits = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    return o.select(
        k.alias("k"),
        F.when(k % 499 == 1, " ").otherwise(F.format_string("case-%d", k)).alias("case_id"),
        F.when(k % 251 == 3, "").otherwise(F.format_string(" question %d ", c)).alias("question"),
        F.when(k % 7 == 0, "clarify").otherwise("answer").alias("expected_behavior"),
        F.when(k % 113 == 9, none).otherwise(lits("orders", "LineItem ")).alias("expected_tables"),
        F.when(k % 3 == 0, lits("area")).otherwise(none).alias("expected_dimensions"),
        lits("balance").alias("expected_metrics"),
        F.array(F.lit("dt = '199706'"), F.concat(F.lit("status = '"), "o_orderstatus", F.lit("'"))).alias("expected_filters"),
        F.when(k % 3 == 0, lits("area")).otherwise(none).alias("expected_group_by"),
        (k % 2 == 0).alias("require_dimension_match"),
        (k % 4 == 0).alias("require_group_by_match"),
        (k % 7 != 0).alias("expected_trusted_sql"),
    )


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a system answered: most right, with noise in case and spaces, and errors of each kind; some are missing."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 17 != 4)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lits = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    return o.select(
        F.format_string("case-%d", k).alias("case_id"),
        F.when(k % 199 == 8, "another question").otherwise(F.format_string("question %d", c)).alias("question"),
        F.when(k % 29 == 5, "error").when((k % 7 == 0) & (k % 5 != 0), "clarify").when(k % 31 == 2, "clarify").otherwise("answer").alias("behavior"),
        F.when(k % 11 == 3, lits("orders", "lineitem", "part")).otherwise(lits(" ORDERS", "lineitem", "", "lineitem")).alias("tables"),
        F.when((k % 3 == 0) & (k % 9 != 0), lits("Area")).otherwise(none).alias("dimensions"),
        F.when(k % 13 == 6, lits("rate")).otherwise(lits("Balance")).alias("metrics"),
        F.array(F.concat(F.lit("STATUS='"), "o_orderstatus", F.lit("'")), F.when(k % 19 == 7, F.lit("dt='199707'")).otherwise(F.lit("dt  =  '199706'"))).alias("filters"),
        F.when((k % 3 == 0) & (k % 6 != 3), lits("area")).otherwise(none).alias("group_by"),
        (k % 23 != 1).alias("success"),
        F.when(k % 37 == 2, None).when(k % 37 == 3, " \n").otherwise("SELECT 1").alias("trusted_sql"),
    )


OUTPUTS = (
    '{"rule_id": "LLM_A", "title": "t", "severity": "HIGH", "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 0.5}',
    'Here:\n```json\n{"rule_id": "LLM_B", "title": "t", "severity": "low", "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 1.5}\n```',
    '{"rule_id": "B", "title": "t", "severity": "low", "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 1}',
    '{"rule_id": "LLM_C", "severity": "low", "extra": 1}',
    '{"fixed_sql": "select 1", "applied_fixes": ["a"], "manual_notes": []}',
    '```\n{"fixed_sql": "select 1", "applied_fixes": [], "notes": []}\n```',
    '{"status": "ready", "plan": {"tables": ["orders"], "metrics": ["balance"], "filters": ["k = %d"]}}',
    '{"status": "need_clarification", "question": "Which month?", "missing_context": ["month"], "reason": "no period"}',
    '{"tables": ["lineitem"], "group_by": ["area"]}',
    '{"status": "FAIL", "missing_requirements": ["period %d"], "issues": ["wrong join"]}',
    '{"status": "pass", "missing_requirements": [], "issues": []}',
    "not json at all",
    '{"rule_id": null, "title": "t", "severity": "low", "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 1}',
    '{"rule_id": "LLM_D", "title": "t", "severity": null, "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 1}',
    '{"fixed_sql": 5, "applied_fixes": [], "manual_notes": []}',
    '{"issues": [{"rule_id": "LLM_E", "title": "t", "severity": "Low", "message": "m", "suggestion": "s", "evidence": "e", "category": "c", "confidence": 0}, {"rule_id": "F", "severity": "low"}, "text"]}',
    '{"issues": []}',
    '{"issues": "none"}',
)


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(output_id, raw): an answer per event, right ones and ones that break each rule."""
    e = table(spark, sf_dir, "events")
    raw = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.pmod("event_id", F.lit(len(OUTPUTS))) + 1).cast("int"))
    return e.select(F.col("event_id").alias("output_id"), F.replace(raw, F.lit("%d"), F.col("user_id").cast("string")).alias("raw"))


def thread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_id, seq, event, text): a thread's first turn starts it, the assistant asks for clarification, the user
    answers. Some answers are blank, some events unknown, some come twice."""
    c = table(spark, sf_dir, "conversations")
    event = F.when((F.col("turn") == 0) | (F.col("role") == "system"), "start").when(F.col("role") == "assistant", F.when(F.char_length("text") % 4 == 0, "attempt_failed").when(F.char_length("text") % 4 == 1, "attempt_passed").otherwise("clarification")).when(F.char_length("text") % 23 == 0, "ping").otherwise("answer")
    text = F.when(F.char_length("text") % 19 == 0, " ").when(F.char_length("text") % 17 == 0, "\n\t").otherwise(F.col("text"))
    rows = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), event.alias("event"), text.alias("text"))
    return rows.unionByName(rows.filter("(thread_id + seq) % 5 = 0"))
