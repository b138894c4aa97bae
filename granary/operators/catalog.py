"""Table and column catalog: ingestion of data dictionaries, checks before publishing, lookup and ranked search."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from granary.functions.text import clean, last_segment, layer, name_key
from granary.sources.shared import written

DICTIONARY = ("row_no", "table_name", "column_name", "table_desc", "column_desc")
SCHEMA_VERSION = 2
#: A side with at most this many rows is broadcast.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Whether the rows, counted, are few enough to broadcast."""
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, few: bool) -> DataFrame:
    """df with a broadcast hint if it is known to be small; else Spark picks the join."""
    return F.broadcast(df) if few else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], few: bool, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """left joined to a table of lookups, right: broadcast if that is known to be small. Else each key is split over so many
    tasks by a hash of left's column `by`, so that a name that many rows hold doesn't meet in one task; by a shuffle, as Spark
    would judge right by its files, without the copies that this makes of each row."""
    if few:
        return left.join(F.broadcast(right), keys, how)
    spread = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread.hint("merge"), [*keys, "salt_"], how).drop("salt_")


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    return hinted(df, is_small(df, limit))


CELLS = ["table_name", "column_name", "table_desc", "column_desc"]


def cells(rows: DataFrame) -> DataFrame:
    """Cleaned cells, names in lower case. named: whether the row has both a table and a column."""
    if missing := [c for c in DICTIONARY if c not in rows.columns]:
        raise ValueError(f"the dictionary has no column {missing}")
    out = rows.select("row_no", name_key("table_name").alias("table_name"), name_key("column_name").alias("column_name"), clean("table_desc").alias("table_desc"), clean("column_desc").alias("column_desc"))
    return out.withColumn("named", (F.col("table_name") != "") & (F.col("column_name") != ""))


def accepted(rows: DataFrame) -> DataFrame:
    """The first of each four equal cells, of the named rows. An aggregation, combined before the shuffle."""
    return cells(rows).filter("named").groupBy(*CELLS).agg(F.min("row_no").alias("row_no"))


def primary_description(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, description): the most frequent text that isn't empty; of equally frequent ones the one seen first."""
    counts = rows.filter(F.col(text) != "").groupBy(*keys, text).agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(text, F.struct(-F.col("n"), "first")).alias("description"))


def dictionary_tables(rows: DataFrame) -> DataFrame:
    """(table_name, description, layer, n_columns)."""
    kept = accepted(rows)
    counts = kept.groupBy("table_name").agg(F.countDistinct("column_name").alias("n_columns"))
    named = counts.join(primary_description(kept, ["table_name"], "table_desc"), "table_name", "left")
    return named.select("table_name", F.coalesce("description", F.lit("")).alias("description"), layer("table_name").alias("layer"), "n_columns")


def dictionary_columns(rows: DataFrame) -> DataFrame:
    """(table_name, column_name, description, ordinal): the ordinal counts a table's columns by first appearance."""
    kept = accepted(rows)
    keys = ["table_name", "column_name"]
    firsts = kept.groupBy(*keys).agg(F.min("row_no").alias("first"))
    ordinal = F.row_number().over(Window.partitionBy("table_name").orderBy("first", "column_name"))
    described = firsts.withColumn("ordinal", ordinal).join(primary_description(kept, keys, "column_desc"), keys, "left")
    return described.select(*keys, F.coalesce("description", F.lit("")).alias("description"), "ordinal")


def accounting(rows: DataFrame) -> DataFrame:
    """One row: raw, accepted, duplicate and skipped rows (raw is the sum of the others), tables and columns."""
    n, named = F.col("n"), F.col("named")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return cells(rows).groupBy("named", *CELLS).agg(F.count("*").alias("n")).agg(
        total("n").alias("raw_rows"),
        F.count_if("named").alias("accepted_rows"),
        total(F.when(named, n - 1)).alias("duplicate_rows"),
        total(F.when(~named, n)).alias("skipped_rows"),
        F.countDistinct(F.when(named, F.col("table_name"))).alias("n_tables"),
        F.countDistinct(F.when(named, F.struct("table_name", "column_name"))).alias("n_columns"),
    )


def gate(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Violations that stop a publication: (check_name, violations)."""
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    twice = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    none = tables.agg(F.count("*").alias("n")).select(F.lit("no_tables").alias("check_name"), F.when(F.col("n") == 0, 1).otherwise(0).cast("long").alias("violations"))
    parts = [
        none,
        count(twice(tables, "table_name"), "table_twice"),
        count(twice(columns, "table_name", "column_name"), "column_twice"),
        count(columns.join(tables.select("table_name"), "table_name", "left_anti"), "column_without_table"),
        count(tables.join(columns.select("table_name"), "table_name", "left_anti"), "table_without_column"),
        count(columns.filter("ordinal < 1 OR column_name = ''"), "bad_column"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publish(rows: DataFrame, path: str, source: str) -> str:
    """Build tables and columns aside, check them, and make the build current by writing its pointer last. A build that
    fails leaves the one before it current. Returns the build's id."""
    spark = rows.sparkSession
    build = uuid.uuid4().hex
    dictionary_tables(rows).write.parquet(f"{path}/builds/{build}/tables")
    dictionary_columns(rows).write.parquet(f"{path}/builds/{build}/columns")
    tables, columns = (spark.read.parquet(f"{path}/builds/{build}/{x}") for x in ("tables", "columns"))
    if failed := [r["check_name"] for r in gate(tables, columns).filter("violations > 0").collect()]:
        raise ValueError(f"not published: {', '.join(sorted(failed))}")
    info = spark.createDataFrame([(build, SCHEMA_VERSION, source)], "build_id string, schema_version int, source string")
    info.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/build_info")
    return build


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of the current build; another schema version is an error."""
    info = spark.read.parquet(f"{path}/build_info").orderBy(F.col("built_at").desc()).first()
    if info is None or info["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"no build with schema version {SCHEMA_VERSION}")
    root = f"{path}/builds/{info['build_id']}"
    return spark.read.parquet(f"{root}/tables"), spark.read.parquet(f"{root}/columns")


def resolve(names: DataFrame, tables: DataFrame, name: str = "name") -> DataFrame:
    """names with resolved and status: the full name first, else the last dotted segment; FOUND or NOT_FOUND."""
    known = tables.select(F.col("table_name").alias("known")).distinct()
    whole = known.select(F.col("known").alias("whole_key"), F.col("known").alias("whole_hit"))
    short = known.select(F.col("known").alias("short_key"), F.col("known").alias("short_hit"))
    keyed = names.withColumn("whole_key", name_key(name)).withColumn("short_key", last_segment("whole_key"))
    found = keyed.join(whole, "whole_key", "left").join(short, "short_key", "left")
    hit = F.when(F.col("whole_key") != "", F.coalesce("whole_hit", "short_hit"))
    return found.withColumn("resolved", hit).withColumn("status", F.when(F.col("resolved").isNotNull(), "FOUND").otherwise("NOT_FOUND")).drop("whole_key", "short_key", "whole_hit", "short_hit")


def usages(columns: DataFrame, tables: DataFrame, names: DataFrame) -> DataFrame:
    """Every table that has a column of one of the names (name): (column_name, table_name, layer, ordinal)."""
    wanted = names.select(name_key("name").alias("column_name")).distinct()
    return columns.join(wanted, "column_name", "left_semi").join(tables.select("table_name", "layer"), "table_name").select("column_name", "table_name", "layer", "ordinal")


def profile(columns: DataFrame, partition_names: tuple[str, ...] = ("dt",)) -> DataFrame:
    """(table_name, n_columns, columns, partition_fields, is_partitioned), fields in column order."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "column_name")))
    is_part = lambda x: x["column_name"].isin(*partition_names)
    grouped = columns.groupBy("table_name").agg(ordered.alias("cs"))
    fields = F.transform(F.filter("cs", is_part), lambda x: x["column_name"])
    return grouped.select("table_name", F.size("cs").cast("long").alias("n_columns"), F.concat_ws("|", F.transform("cs", lambda x: x["column_name"])).alias("columns"), F.concat_ws("|", fields).alias("partition_fields"), (F.size(fields) > 0).alias("is_partitioned"))


def overlapping(text: F.Column, key: F.Column) -> F.Column:
    """How often key occurs in text, overlaps included."""
    spots = F.sequence(F.lit(1), F.greatest(F.char_length(text) - F.char_length(key) + 1, F.lit(1)))
    return F.size(F.filter(spots, lambda i: F.substr(text, i, F.char_length(key)) == key))


def grams(text: F.Column, n: int) -> F.Column:
    """The distinct pieces of n characters of a text; none of a shorter one."""
    spots = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(text, i, F.lit(n))))


class GramIndex(NamedTuple):
    """rows: (row, columns..., low_name, low_desc, len), written, row a number. grams: (gram, row), written in order of
    gram, so that a reader of some grams skips the others: pieces of one to three characters of a row's name and
    description. average: the mean of len, the number of trigrams of both."""

    rows: DataFrame
    grams: DataFrame
    names: tuple[str, ...]
    average: float


def gram_index(rows: DataFrame, names: tuple[str, ...]) -> GramIndex:
    """Index rows by the grams of their name and description; names = (key columns..., name, description)."""
    *keys, name, description = names
    lower = rows.select(*keys, F.col(name).alias("hit_name"), F.lower(name).alias("low_name"), F.coalesce(F.lower(description), F.lit("")).alias("low_desc")).filter("low_name IS NOT NULL")
    length = lambda c: F.greatest(F.char_length(c) - 2, F.lit(0))
    held = written(lower.withColumn("row", F.monotonically_increasing_id()).withColumn("len", (length("low_name") + length("low_desc")).cast("double")), "rows")
    pieces = F.array_distinct(F.concat(*[grams(F.col(c), n) for c in ("low_name", "low_desc") for n in (1, 2, 3)]))
    cells = held.select("row", F.explode(pieces).alias("gram"))
    return GramIndex(held, written(cells.repartitionByRange("gram", "row").sortWithinPartitions("gram"), "grams"), tuple(names), held.agg(F.avg("len").alias("a")).first()["a"] or 1.0)


def rarest(index: GramIndex, wanted: DataFrame) -> DataFrame:
    """(keyword, gram): the gram of each keyword (of three characters, or the keyword if it is shorter) that fewest rows
    have. Keywords with a gram that no row has are left out, as nothing can hold them."""
    own = F.when(F.char_length("keyword") >= 3, grams(F.col("keyword"), 3)).otherwise(F.array("keyword"))
    parts = wanted.select("keyword", F.explode(own).alias("gram"))
    counts = index.grams.join(small(parts.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    each = parts.join(counts, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
    return each.filter("absent = 0").select("keyword", "gram")


def search(rows: DataFrame | GramIndex, keywords: DataFrame, names: tuple[str, ...], limit: int) -> DataFrame:
    """Ranked search of each keyword in rows' name and description columns: names = (key columns..., name, description).

    Blank keywords find nothing. An exact name comes first. Keywords under 3 characters match anywhere in name or
    description and are ordered by name. Longer ones are scored as a phrase of trigrams: hits (overlaps count) against
    the length of both columns, so that many hits in little text rank high; then by name. At most limit rows a keyword.
    Rows meet a keyword on its rarest gram, whatever the number of keywords; rows may be an index that was built."""
    index = rows if isinstance(rows, GramIndex) else gram_index(rows, names)
    keys = list(index.names[:-2])
    wanted = keywords.select(name_key("keyword").alias("keyword")).filter("keyword != ''").distinct()
    met = index.grams.join(small(written(rarest(index, written(wanted, "keywords")), "rarest")), "gram").select("row", "keyword")
    pairs = index.rows.join(met, "row").filter(F.col("low_name").contains(F.col("keyword")) | F.col("low_desc").contains(F.col("keyword")))
    tf = (overlapping(F.col("low_name"), F.col("keyword")) + overlapping(F.col("low_desc"), F.col("keyword"))).cast("double")
    score = F.when(F.char_length("keyword") >= 3, F.round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / index.average)), 9)).otherwise(0.0)
    exact = F.when(F.col("low_name") == F.col("keyword"), 1).otherwise(0)
    order = Window.partitionBy("keyword").orderBy(F.col("exact").desc(), F.col("score").desc(), "hit_name", *keys)
    ranked = pairs.withColumn("exact", exact).withColumn("score", score).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= limit).select("keyword", *keys, "hit_name", "exact", "score", "position")


def table_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_distinct). Distinct counts are estimated in one pass by HyperLogLog, or, if exact,
    taken from each column's distinct values, combined before the shuffle."""
    distinct = (lambda c: F.lit(None).cast("long")) if exact else F.approx_count_distinct
    counted = df.agg(*[F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), distinct(c).alias("n_distinct")).alias(c) for c in df.columns])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.n_rows"), F.col(f"{c}.n_nulls"), F.col(f"{c}.n_distinct")) for c in df.columns])).alias("x")).select("x.*")
    if not exact:
        return rows
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    exact_counts = cells.filter("value IS NOT NULL").distinct().groupBy("column_name").agg(F.count("*").alias("n_values"))
    return rows.join(F.broadcast(exact_counts), "column_name", "left").select("column_name", "n_rows", "n_nulls", F.coalesce("n_values", F.lit(0)).alias("n_distinct"))


def period_sketches(df: DataFrame, period: str) -> DataFrame:
    """(period, column_name, n_rows, n_nulls, n_bytes, distinct, quantiles), written: what is known of each column in each
    period, to be merged for any range of periods without reading rows again.

    distinct is a HyperLogLog sketch (relative error about 1.6 %), quantiles a KLL sketch of a numeric column (rank error
    about 1.3 %), null for others. n_bytes counts fixed widths, and the UTF-8 bytes of texts."""
    kinds = {f.name: f.dataType for f in df.schema if f.name != period}
    fixed = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "double": 8, "float": 4, "timestamp": 8, "date": 4, "boolean": 1}
    numeric = lambda t: isinstance(t, NumericType)

    def sketched(c: str) -> F.Column:
        kind = kinds[c].simpleString()
        width = F.lit(fixed.get(kind, 16)) if kind not in ("string", "binary") else F.octet_length(c)
        held = F.expr(f"kll_sketch_agg_double(cast(`{c}` AS double))") if numeric(kinds[c]) else F.lit(None).cast("binary")
        return F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), width)), F.lit(0)).cast("long").alias("n_bytes"), F.expr(f"hll_sketch_agg(cast(`{c}` AS string), 12)").alias("distinct"), held.alias("quantiles")).alias(c)

    wide = df.groupBy(period).agg(*[sketched(c) for c in kinds])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in kinds])).alias("y")
    return written(wide.select(period, each).select(period, "y.column_name", "y.x.*"), "sketches")


def merged_stats(sketches: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_bytes, n_distinct, median) over all periods of the given sketches."""
    out = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.sum("n_bytes").alias("n_bytes"),
        F.expr("hll_sketch_estimate(hll_union_agg(distinct))").alias("n_distinct"),
        F.expr("kll_merge_agg_double(quantiles)").alias("q"),
    )
    median = F.when(F.expr("kll_sketch_get_n_double(q)") > 0, F.expr("kll_sketch_get_quantile_double(q, 0.5D)"))
    return out.select("column_name", "n_rows", "n_nulls", "n_bytes", "n_distinct", median.alias("median"))
