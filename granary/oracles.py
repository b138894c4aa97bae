"""SQL for DuckDB that gives the registered queries' rows, written apart from the operators."""

from __future__ import annotations

import re

from granary.functions.text import WIDE_SPACES
from granary.operators.facts import KEYWORDS
from granary.sources.bindings import CATALOG, MODES, OUTPUTS, SCRIPTS


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(c.strip() for c in ctes if c) + "\n"


LOANS = """
loans AS (
  SELECT l_orderkey || '-' || l_linenumber AS loan_iou_no, o_custkey AS ent_code, n_name AS area, o_orderpriority AS org_type, p_type AS green,
    l_extendedprice::DECIMAL(22,2) AS bal, l_discount::DECIMAL(15,5) AS rate, strftime(l_shipdate, '%Y%m') AS dt,
    CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS high_tech
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
BALANCE, COUNT, RATE = "sum(bal)::DOUBLE AS loan_balance", "count(DISTINCT ent_code) AS enterprise_count", "CASE WHEN sum(bal) = 0 THEN NULL ELSE sum(bal * rate)::DOUBLE / sum(bal)::DOUBLE END AS weighted_rate"

DICT = r"""
dict_raw AS (
  SELECT p_partkey AS row_no,
    CASE WHEN p_partkey % 97 = 5 THEN NULL WHEN p_partkey % 89 = 7 THEN '  ' ELSE ' ' || (['dwd', 'dwd', 'DWD', 'ods', 'ads', 'tmp'])[regexp_extract(p_brand, '\d+')::INT % 6 + 1] || '_' || lower(replace(p_brand, '#', '')) END AS table_name,
    CASE WHEN p_partkey % 101 = 3 THEN NULL ELSE replace(p_name, ' ', '_') || chr(9) END AS column_name,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE lower(p_type) END AS table_desc,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || ' ' || split_part(p_name, ' ', 1) END AS column_desc
  FROM part),
dict_cells AS (
  SELECT row_no, lower(regexp_replace(coalesce(table_name, ''), '^\s+|\s+$', '', 'g')) AS t, lower(regexp_replace(coalesce(column_name, ''), '^\s+|\s+$', '', 'g')) AS c,
    regexp_replace(coalesce(table_desc, ''), '^\s+|\s+$', '', 'g') AS td, regexp_replace(coalesce(column_desc, ''), '^\s+|\s+$', '', 'g') AS cd FROM dict_raw),
dict_fate AS (
  SELECT *, CASE WHEN t = '' OR c = '' THEN 'skipped' WHEN row_number() OVER (PARTITION BY t, c, td, cd ORDER BY row_no) > 1 THEN 'duplicate' ELSE 'accepted' END AS fate FROM dict_cells),
ok AS (SELECT * FROM dict_fate WHERE fate = 'accepted'),
td_first AS (SELECT t, td FROM (SELECT t, td, count(*) AS n, min(row_no) AS f FROM ok WHERE td <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, f) = 1),
cd_first AS (SELECT t, c, cd FROM (SELECT t, c, cd, count(*) AS n, min(row_no) AS f FROM ok WHERE cd <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY n DESC, f) = 1),
dict_t AS (
  SELECT k.t AS table_name, coalesce(td, '') AS description, CASE WHEN split_part(k.t, '_', 1) IN ('ods', 'dim', 'dwd', 'dws', 'ads', 'ver') THEN split_part(k.t, '_', 1) ELSE '' END AS layer, n_columns
  FROM (SELECT t, count(DISTINCT c) AS n_columns FROM ok GROUP BY t) k LEFT JOIN td_first USING (t)),
dict_c AS (
  SELECT k.t AS table_name, k.c AS column_name, coalesce(cd, '') AS description, row_number() OVER (PARTITION BY k.t ORDER BY f, k.c)::INT AS ordinal
  FROM (SELECT t, c, min(row_no) AS f FROM ok GROUP BY t, c) k LEFT JOIN cd_first USING (t, c))"""

KEYS = """
keys AS (SELECT DISTINCT lower(trim(k)) AS keyword FROM (
  SELECT p_type AS k FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT 'w' UNION SELECT '  ') WHERE trim(k) <> '')"""


def search(rows: str, key: str, limit: int) -> str:
    k = f", {key}" if key else ""
    return f"""
sized AS (SELECT *, (greatest(length(low_name) - 2, 0) + greatest(length(low_desc) - 2, 0))::DOUBLE AS len FROM ({rows})),
pairs AS (SELECT * FROM sized, keys, (SELECT avg(len) AS a FROM sized) WHERE contains(low_name, keyword) OR contains(low_desc, keyword)),
hits AS (SELECT *, (len(list_filter(range(1, greatest(length(low_name) - length(keyword) + 1, 1) + 1), lambda i: substr(low_name, i, length(keyword)) = keyword)) + len(list_filter(range(1, greatest(length(low_desc) - length(keyword) + 1, 1) + 1), lambda i: substr(low_desc, i, length(keyword)) = keyword)))::DOUBLE AS tf FROM pairs),
scored AS (SELECT *, CASE WHEN low_name = keyword THEN 1 ELSE 0 END AS exact, CASE WHEN length(keyword) >= 3 THEN round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)), 9) ELSE 0.0::DOUBLE END AS score FROM hits)
SELECT keyword{k}, hit_name, exact, score, row_number() OVER (PARTITION BY keyword ORDER BY exact DESC, score DESC, hit_name{k})::INT AS position FROM scored QUALIFY position <= {limit}"""


SCR = f"""
scr AS (
  SELECT o_orderkey AS script_id, '/scripts/' || o_orderkey || '.sql' AS path, ({strings(MODES)})[o_custkey % 3 + 1] AS mode,
    replace(replace(replace(({strings(SCRIPTS)})[o_orderkey % {len(SCRIPTS)} + 1], '{{c}}', o_custkey::VARCHAR), '{{h}}', (o_custkey // 2)::VARCHAR), '{{d}}', strftime(o_orderdate, '%Y%m%d')) AS sql
  FROM orders)"""
NO_COMMENTS = r"regexp_replace(regexp_replace(sql, '--[^\n]*', '', 'g'), '/\*.*?\*/', '', 'gs')"
PLAIN = f"translate({NO_COMMENTS}, '{WIDE_SPACES}', '     ')"
NORM = rf"lower(trim(regexp_replace({PLAIN}, '\s+', ' ', 'g')))"
TARGET = r"\binsert\s+(?:overwrite|into)\s+(?:table\s+)?([\w.]+)"
SOURCE = r"\b(?:from|join)\s+([\w.]+)"
NAMED = r"^(?:drop|create|truncate)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?([\w.]+)"
CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(t)}, {lit(c.split()[0])}, {str(c.endswith('!')).lower()}, {i + 1}, {lit(c.rstrip('!').replace(';', ',').split(' ', 1)[1])})" for t, cs in CATALOG.items() for i, c in enumerate(cs.split(", "))) + ") v(t, c, is_part, ord, kind))"


def facts(src: str = "scr", p: str = "") -> str:
    """CTEs with the facts of scripts src(script_id, mode, sql); names start with p."""
    return rf"""
{p}st0 AS (SELECT script_id, unnest(string_split(lower(regexp_replace(regexp_replace({PLAIN}, '''[^'']*''|"[^"]*"', '''''', 'g'), '\s+', ' ', 'g')), ';')) AS s, generate_subscripts(string_split({PLAIN}, ';'), 1) AS k FROM {src}),
{p}st AS (SELECT script_id, k, trim(s) AS s, CASE WHEN regexp_extract(trim(s), '^(\w+)', 1) = 'with' THEN CASE WHEN regexp_matches(s, '\binsert\s+(?:into|overwrite)\b') THEN 'insert' ELSE 'select' END ELSE regexp_extract(trim(s), '^(\w+)', 1) END AS kind, regexp_extract_all(s, '{TARGET}', 1)[1] AS target FROM {p}st0 WHERE trim(s) <> ''),
{p}cte AS (SELECT DISTINCT script_id, unnest(regexp_extract_all(s, '(?:\bwith|,)\s*(\w+)\s+as\s*\(', 1)) AS name FROM {p}st),
{p}read AS (SELECT DISTINCT r.script_id, r.k, r.target, r.name FROM (SELECT script_id, k, target, unnest(list_concat(regexp_extract_all(s, '{SOURCE}', 1), regexp_extract_all(s, '{NAMED}', 1))) AS name FROM {p}st) r ANTI JOIN {p}cte c ON r.script_id = c.script_id AND r.name = c.name WHERE r.name IS DISTINCT FROM r.target),
{p}tab AS (SELECT DISTINCT script_id, name AS table_name, 'source' AS role FROM {p}read UNION ALL SELECT DISTINCT script_id, target, 'target' FROM {p}st WHERE target IS NOT NULL),
{p}ref0 AS (SELECT script_id, unnest(regexp_extract_all(s, '{SOURCE}(?:\s+(?:as\s+)?(\w+))?', 1)) AS name, unnest(regexp_extract_all(s, '{SOURCE}(?:\s+(?:as\s+)?(\w+))?', 2)) AS a FROM {p}st),
{p}ref AS (SELECT DISTINCT r.script_id, r.name, CASE WHEN a <> '' AND a NOT IN ({', '.join(map(lit, KEYWORDS))}) THEN a END AS alias FROM {p}ref0 r ANTI JOIN {p}cte c ON r.script_id = c.script_id AND r.name = c.name),
{p}bare AS (SELECT script_id, regexp_replace(regexp_replace(s, '{SOURCE}', ' ', 'g'), '{TARGET}', ' ', 'g') AS b, s FROM {p}st),
{p}col AS (SELECT DISTINCT script_id, unnest(regexp_extract_all(b, '\b(\w+)\.(\w+)\b', 1)) AS qualifier, unnest(regexp_extract_all(b, '\b(\w+)\.(\w+)\b', 2)) AS name FROM {p}bare),
{p}als AS (SELECT DISTINCT script_id, unnest(regexp_extract_all(s, '\bas\s+(\w+)', 1)) AS name FROM {p}st),
{p}ins AS (SELECT script_id, CASE WHEN count(*) = 1 THEN max(target) END AS insert_target, CASE WHEN count(*) = 1 THEN bool_or(regexp_matches(s, '\bpartition\s*\(')) ELSE false END AS has_partition FROM {p}st WHERE kind = 'insert' GROUP BY script_id),
{p}agg AS (
  SELECT script_id, count(*) AS statement_count, string_agg(kind, '|' ORDER BY k) AS statement_types,
    bool_or(regexp_matches(s, '(?:\bselect\s+(?:distinct\s+)?|,\s*)(?:\w+\.)?\*\s*(?:,|from\b|$)')) AS has_select_star, bool_or(kind = 'drop') AS has_drop, bool_or(kind LIKE 'truncate%') AS has_truncate,
    bool_or(kind IN ('insert', 'update', 'delete', 'merge', 'create', 'drop', 'alter')) AS has_write FROM {p}st GROUP BY script_id),
{p}f AS (
  SELECT x.script_id, x.mode, x.sql, a.* EXCLUDE (script_id), i.insert_target, coalesce(i.has_partition, false) AS has_partition, {NORM} AS norm
  FROM {src} x JOIN {p}agg a USING (script_id) LEFT JOIN {p}ins i USING (script_id))"""


def issues(p: str = "", mode: str | None = None) -> str:
    """CTEs {p}rule_issues, {p}tab_issues, {p}col_issues, {p}part_issues and their union {p}issues."""
    in_mode = f"'{mode}' <> 'backfill'" if mode else "mode <> 'backfill'"
    rule = lambda i, sev, cat, cond, ev, action="human_review", src="rule", conf="1.0", fix="false", block="false": f"SELECT script_id, '{i}' AS rule_id, '{sev}' AS severity, '{cat}' AS category, '{src}' AS source, {conf}::DOUBLE AS confidence, '{action}' AS action, {fix} AS auto_fixable, false AS requires_metadata, false AS requires_knowledge, {block} AS blocking, {ev} AS evidence, NULL::VARCHAR AS table_name, NULL::VARCHAR AS column_name FROM {p}f WHERE {cond}"
    rules = [
        rule("SELECT_STAR", "medium", "style", "has_select_star", "'select list with *'"),
        rule("DROP_OR_TRUNCATE", "high", "safety", "has_drop OR has_truncate", "'drop or truncate'", action="block", block="true"),
        rule("NON_ASCII_WHITESPACE", "low", "style", f"regexp_matches(sql, '[{WIDE_SPACES}]')", "'wide white space'"),
        rule("MAXCOMPUTE_INSERT_OVERWRITE_TABLE_REQUIRED", "high", "maxcompute", r"regexp_matches(regexp_replace(norm, '\binsert\s+overwrite\s+table\b', '', 'g'), '\binsert\s+overwrite\s')", "'insert overwrite without table'", action="auto_fix", fix="true"),
        rule("DATAWORKS_HARDCODED_DATE", "medium", "dataworks", rf"""{in_mode} AND regexp_matches(norm, '\b(ds|dt|biz_date|stat_date|pt|partition_date)\s*=\s*(''\d{{8}}''|"\d{{8}}")')""", "'date literal on a partition column'"),
        rule("LLM_AGGREGATION_NULL_HANDLING_SUGGESTION", "medium", "semantic", "contains(norm, 'sum(') AND NOT contains(norm, 'coalesce') AND NOT contains(norm, 'nvl')", "'sum without coalesce'", src="llm", conf="0.7"),
        rule("LLM_JOIN_DUPLICATION_RISK", "medium", "semantic", "contains(norm, ' join ') AND contains(norm, ' group by ')", "'join then group by'", src="llm", conf="0.65"),
    ]
    fixed = lambda i, ev, src, action="block", block="true", about="table_name", column="NULL": f"SELECT script_id, '{i}' AS rule_id, 'high' AS severity, 'metadata' AS category, '{src}' AS source, 1.0::DOUBLE AS confidence, '{action}' AS action, false AS auto_fixable, false AS requires_metadata, false AS requires_knowledge, {block} AS blocking, {ev} AS evidence, {about} AS table_name, {column}::VARCHAR AS column_name"
    return f"""
{p}rule_issues AS ({" UNION ALL ".join(rules)}),
{p}tab_issues AS ({fixed("TABLE_NOT_FOUND", "table_name", "system")} FROM (SELECT DISTINCT script_id, table_name FROM {p}tab) WHERE table_name NOT IN (SELECT t FROM cat) AND split_part(table_name, '.', -1) NOT IN (SELECT t FROM cat)),
{p}own AS (SELECT DISTINCT script_id, t AS owner, unnest([name, split_part(name, '.', -1), alias]) AS qualifier FROM {p}ref JOIN (SELECT DISTINCT t FROM cat) ON t = name OR (name NOT IN (SELECT t FROM cat) AND t = split_part(name, '.', -1))),
{p}col_issues AS ({fixed("COLUMN_NOT_FOUND", "qualifier || '.' || name", "system", about="owner", column="name")} FROM (SELECT script_id, qualifier, name, min(owner) AS owner FROM (SELECT c.script_id, c.qualifier, c.name, o.owner FROM {p}col c JOIN {p}own o ON o.script_id = c.script_id AND o.qualifier = c.qualifier ANTI JOIN {p}als a ON a.script_id = c.script_id AND a.name = c.name) x ANTI JOIN {p}cte k ON k.script_id = x.script_id AND k.name = x.qualifier WHERE (owner, name) NOT IN (SELECT (t, c) FROM cat) GROUP BY ALL)),
{p}part_issues AS ({fixed("INSERT_WITHOUT_PARTITION", "insert_target", "rule", "human_review", "false", about="insert_target")} FROM {p}f WHERE NOT has_partition AND insert_target IN (SELECT t FROM cat WHERE is_part)),
{p}issues AS (SELECT * FROM {p}rule_issues UNION ALL SELECT * FROM {p}tab_issues UNION ALL SELECT * FROM {p}col_issues UNION ALL SELECT * FROM {p}part_issues)"""


RISK = """
risk AS (
  SELECT s.script_id, CASE WHEN count_if(severity = 'high') > 0 THEN 'high' WHEN count_if(severity = 'medium') > 0 THEN 'medium' ELSE 'low' END AS risk_level, count(rule_id) AS n_issues,
    coalesce(count_if(severity = 'high'), 0)::BIGINT AS n_high, coalesce(count_if(severity = 'medium'), 0)::BIGINT AS n_medium, coalesce(count_if(severity = 'low'), 0)::BIGINT AS n_low
  FROM scr s LEFT JOIN issues USING (script_id) GROUP BY s.script_id)"""
TOP = """
top AS (
  SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE source WHEN 'rule' THEN 3 WHEN 'system' THEN 2 ELSE 1 END DESC, rule_id, evidence)::INT AS position, rule_id, severity, source, evidence
  FROM issues QUALIFY position <= 5)"""
ROUTE = """
route AS (
  SELECT s.script_id, CASE WHEN n IS NULL THEN 'complete' WHEN blocks THEN 'block' WHEN fixable THEN 'auto_fix' ELSE 'human_review' END AS route,
    CASE WHEN n IS NULL THEN 'no_issue' WHEN blocks THEN 'blocked' WHEN fixable THEN NULL ELSE 'need_human_confirm' END AS final_status, coalesce(n, 0) AS n_actionable
  FROM scr s LEFT JOIN (SELECT script_id, count(*) AS n, bool_or(blocking OR action = 'block') AS blocks, bool_and(action = 'auto_fix' AND auto_fixable) AS fixable FROM issues GROUP BY script_id) USING (script_id))"""
FIX = rf"""
flag AS (
  SELECT script_id, bool_or(rule_id = 'NON_ASCII_WHITESPACE') AS f1, bool_or(rule_id = 'MAXCOMPUTE_INSERT_OVERWRITE_TABLE_REQUIRED') AS f2, bool_or(rule_id = 'DATAWORKS_HARDCODED_DATE') AS f3, bool_or(rule_id = 'INSERT_WITHOUT_PARTITION') AS f4,
    list(DISTINCT rule_id || ': ' || evidence ORDER BY rule_id || ': ' || evidence) FILTER (WHERE rule_id IN ('COLUMN_NOT_FOUND', 'TABLE_NOT_FOUND') OR rule_id LIKE 'LLM%') AS notes
  FROM issues GROUP BY script_id),
step1 AS (SELECT script_id, mode, sql, insert_target, flag.* EXCLUDE (script_id), CASE WHEN f1 THEN translate(sql, '{WIDE_SPACES}', '     ') ELSE sql END AS s1 FROM f JOIN flag USING (script_id)),
step2 AS (SELECT *, CASE WHEN f2 THEN regexp_replace(s1, '(?i)\binsert\s+overwrite\s+(?:table\s+)?', 'insert overwrite table ', 'g') ELSE s1 END AS s2 FROM step1),
step3 AS (SELECT *, CASE WHEN f3 THEN regexp_replace(s2, '(?i)\b(ds|dt|biz_date|stat_date|pt|partition_date)\s*=\s*(?:''\d{{8}}''|"\d{{8}}")', '\1 = ''${{bizdate}}''', 'g') ELSE s2 END AS s3 FROM step2),
step4 AS (SELECT *, CASE WHEN f4 THEN regexp_replace(s3, '(?i)(\binsert\s+(?:overwrite|into)\s+table\s+ads_order_summary)\b', '\1 partition(dt=''${{bizdate}}'')', 'g') ELSE s3 END AS s4 FROM step3),
fixed AS (
  SELECT script_id, mode, CASE WHEN len(all_notes) = 0 THEN s4 ELSE rtrim(s4) || chr(10) || chr(10) || '-- ================= AI REVIEW TODO =================' || chr(10) || array_to_string(list_transform(all_notes, lambda x: '-- AI_REVIEW_TODO: ' || x), chr(10)) || chr(10) END AS fixed_sql,
    array_to_string(list_filter([CASE WHEN s1 <> sql THEN 'spaces' END, CASE WHEN s2 <> s1 THEN 'keyword' END, CASE WHEN s3 <> s2 THEN 'date' END, CASE WHEN s4 <> s3 THEN 'partition' END], lambda x: x IS NOT NULL), '|') AS applied_fixes,
    array_to_string(all_notes, '|') AS manual_notes
  FROM (SELECT *, list_concat(CASE WHEN f4 AND s4 = s3 THEN ['partition: target_not_located'] ELSE [] END, coalesce(notes, [])) AS all_notes FROM step4))"""
CRITIC = """
verdict AS (
  SELECT b.script_id, CASE WHEN b.n > 0 AND applied_fixes = '' THEN 'no_applied_fixes' WHEN coalesce(a.n, 0) > 0 THEN 'issues_remaining' WHEN manual_notes <> '' THEN 'need_human_confirm' ELSE 'passed' END AS status
  FROM (SELECT script_id, count(*) AS n FROM issues GROUP BY script_id) b JOIN fixed USING (script_id) LEFT JOIN (SELECT script_id, count(*) AS n FROM b_issues GROUP BY script_id) a USING (script_id))"""



def second(cte: str) -> str:
    """A round's CTE for the round after it."""
    return re.sub(r"\b(scr|flag|step\d|fixed|issues|b_issues|f|verdict|route)\b(?!\s*=|,| AS (?:route|b_))", lambda m: {"b_issues": "c_issues"}.get(m[1], "b_" + m[1]), cte)


LISTS = "list_sort(list_distinct(list_filter(list_transform({0}, lambda x: lower(trim(x))), lambda x: x <> '')))"
FILTERS = r"list_sort(list_distinct(list_filter(list_transform({0}, lambda x: lower(regexp_replace(x, '\s+', '', 'g'))), lambda x: x <> '')))"
GOLDEN = """
golden AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 499 = 1 THEN ' ' ELSE 'case-' || o_orderkey END AS case_id, CASE WHEN o_orderkey % 251 = 3 THEN '' ELSE ' question ' || o_custkey || ' ' END AS question,
    CASE WHEN o_orderkey % 7 = 0 THEN 'clarify' ELSE 'answer' END AS eb, CASE WHEN o_orderkey % 113 = 9 THEN [] ELSE ['orders', 'LineItem '] END AS et, CASE WHEN o_orderkey % 3 = 0 THEN ['area'] ELSE [] END AS ed, ['balance'] AS em,
    ['dt = ''199706''', 'status = ''' || o_orderstatus || ''''] AS ef, CASE WHEN o_orderkey % 3 = 0 THEN ['area'] ELSE [] END AS eg, o_orderkey % 2 = 0 AS rd, o_orderkey % 4 = 0 AS rg, o_orderkey % 7 <> 0 AS ets FROM orders),
reasoned AS (SELECT *, list_filter([CASE WHEN trim(case_id) = '' THEN 'blank_id' END, CASE WHEN trim(question) = '' THEN 'blank_question' END, CASE WHEN eb = 'answer' AND len(et) = 0 THEN 'answer_without_tables' END, CASE WHEN eb = 'clarify' AND ets THEN 'clarify_with_trusted_sql' END], lambda x: x IS NOT NULL) AS reasons FROM golden),
actual AS (
  SELECT 'case-' || o_orderkey AS case_id, CASE WHEN o_orderkey % 199 = 8 THEN 'another question' ELSE 'question ' || o_custkey END AS aq,
    CASE WHEN o_orderkey % 29 = 5 THEN 'error' WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'clarify' WHEN o_orderkey % 31 = 2 THEN 'clarify' ELSE 'answer' END AS ab,
    CASE WHEN o_orderkey % 11 = 3 THEN ['orders', 'lineitem', 'part'] ELSE [' ORDERS', 'lineitem', '', 'lineitem'] END AS got_t, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 THEN ['Area'] ELSE [] END AS ad,
    CASE WHEN o_orderkey % 13 = 6 THEN ['rate'] ELSE ['Balance'] END AS am, ['STATUS=''' || o_orderstatus || '''', CASE WHEN o_orderkey % 19 = 7 THEN 'dt=''199707''' ELSE 'dt  =  ''199706''' END] AS af,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 3 THEN ['area'] ELSE [] END AS ag, o_orderkey % 23 <> 1 AS success, CASE WHEN o_orderkey % 37 = 2 THEN NULL WHEN o_orderkey % 37 = 3 THEN ' ' || chr(10) ELSE 'SELECT 1' END AS trusted_sql
  FROM orders WHERE o_orderkey % 17 <> 4),
al AS (SELECT * FROM reasoned LEFT JOIN actual USING (case_id) WHERE len(reasons) = 0)"""
EVAL = f"""
ev0 AS (SELECT *, coalesce(ab, 'error') AS behavior, coalesce(ab, 'error') = 'answer' AND eb = 'answer' AS two FROM al WHERE coalesce(trim(aq) = trim(question), true)),
ev1 AS (
  SELECT case_id, eb AS expected_behavior, behavior, rd, rg, behavior = eb AS behavior_ok,
    CASE WHEN two THEN {LISTS.format("et")} = {LISTS.format("got_t")} END AS table_ok, CASE WHEN two THEN {LISTS.format("em")} = {LISTS.format("am")} END AS metric_ok, CASE WHEN two THEN {FILTERS.format("ef")} = {FILTERS.format("af")} END AS filter_ok,
    CASE WHEN two THEN {LISTS.format("ed")} = {LISTS.format("ad")} END AS dimension_ok, CASE WHEN two THEN {LISTS.format("eg")} = {LISTS.format("ag")} END AS group_by_ok,
    CASE WHEN behavior = 'answer' THEN coalesce(success, false) END AS pipeline_ok, CASE WHEN two THEN (trusted_sql IS NOT NULL AND regexp_matches(trusted_sql, '\\S')) = ets END AS trusted_ok FROM ev0),
ev AS (
  SELECT * EXCLUDE (rd, rg), CASE WHEN behavior = 'error' THEN false WHEN behavior = 'clarify' THEN behavior_ok ELSE behavior_ok AND coalesce(table_ok AND metric_ok AND filter_ok AND (NOT rd OR coalesce(dimension_ok, false)) AND (NOT rg OR coalesce(group_by_ok, false)) AND pipeline_ok AND trusted_ok, false) END AS passed FROM ev1)"""
RATES = "count(*) AS total, count_if(passed)::BIGINT AS passed, count_if(NOT passed AND behavior <> 'error')::BIGINT AS failed, count_if(behavior = 'error')::BIGINT AS errors, avg(passed::INT) AS pass_rate, " + ", ".join(f"coalesce(avg({c}_ok::INT), 0.0) AS {c}_rate" for c in ("behavior", "table", "metric", "filter", "dimension", "group_by", "pipeline", "trusted")) + ", avg((behavior = 'error')::INT) AS error_rate"

OUT = f"""
out0 AS (SELECT event_id AS output_id, trim(replace(({strings(OUTPUTS)})[event_id % {len(OUTPUTS)} + 1], '%d', user_id::VARCHAR), ' ' || chr(10)) AS raw FROM events),
out1 AS (SELECT output_id, CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE raw END AS o FROM out0),
out2 AS (SELECT output_id, TRY_CAST(o AS JSON) AS j FROM out1),
out AS (SELECT output_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS obj, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE [] END AS keys FROM out2)"""
JOINED = "array_to_string(list_sort({0}), '|')"


def differ(fields: tuple[str, ...]) -> str:
    return f"list_filter({strings(fields)}, lambda x: NOT list_contains(keys, x)) AS missing, list_filter(keys, lambda x: NOT list_contains({strings(fields)}, x)) AS extra"


def jlist(path: str) -> str:
    return f"array_to_string((json_extract(obj, '{path}')::VARCHAR[]), '|')"


TOKENS = r"""
doc AS (SELECT printf('doc-%012d', doc_id) AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'verified_sql' ELSE 'business_knowledge' END AS kind, lower(coalesce(text, '')) AS low, text FROM documents),
chars AS (SELECT document_id, low, regexp_replace(low, '[^\x{4E00}-\x{9FFF}]+', '', 'g') AS z FROM doc),
tok AS (SELECT document_id, unnest(list_concat(regexp_extract_all(low, '[A-Za-z0-9_]+'), CASE WHEN length(z) >= 2 THEN list_transform(range(1, length(z)), lambda i: substr(z, i, 2)) ELSE [] END)) AS token FROM chars)"""
BUCKET = "(('0x' || substr(md5(token), 1, 8))::BIGINT % 262144)"
SIMS = f"""
qtok AS (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS token FROM benchmark),
q AS (SELECT question_id, {BUCKET} AS b, count(*) AS n FROM qtok GROUP BY ALL),
d AS (SELECT document_id, {BUCKET} AS b, count(*) AS n FROM tok GROUP BY ALL),
qn AS (SELECT question_id, sqrt(sum(n * n)::DOUBLE) AS qq FROM q GROUP BY ALL), dn AS (SELECT document_id, sqrt(sum(n * n)::DOUBLE) AS dd FROM d GROUP BY ALL),
sims AS (SELECT question_id, document_id, kind, round(dot::DOUBLE / (qq * dd), 6) AS score FROM (SELECT question_id, document_id, sum(q.n * d.n) AS dot FROM q JOIN d USING (b) GROUP BY ALL) JOIN qn USING (question_id) JOIN dn USING (document_id) JOIN doc USING (document_id))"""


def top(src: str, k: int) -> str:
    return f"SELECT question_id, document_id, kind, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id)::INT AS position FROM {src} QUALIFY position <= {k}"


THREADS = r"""
e0 AS (SELECT conv_id AS thread_id, turn AS seq, CASE WHEN turn = 0 OR role = 'system' THEN 'start' WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 'attempt_failed' WHEN 1 THEN 'attempt_passed' ELSE 'clarification' END WHEN length(text) % 23 = 0 THEN 'ping' ELSE 'answer' END AS event, CASE WHEN length(text) % 19 = 0 THEN ' ' WHEN length(text) % 17 = 0 THEN chr(10) || chr(9) ELSE text END AS text FROM conversations),
st AS (SELECT thread_id, count_if(event = 'start')::INT AS turn_no, max(CASE WHEN event = 'start' THEN seq END) AS s FROM e0 GROUP BY thread_id)"""
