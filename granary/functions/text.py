"""Text functions as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space characters that editors insert unseen, all white space (as (?U)\\s has it), and the warehouse layers.
WIDE_SPACES = "\u3000\u00a0\u2002\u2003\u2009"
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LAYERS = ("ods", "dim", "dwd", "dws", "ads", "ver")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """A cell's text without white space (of any script) at its ends; null as the empty text."""
    return F.btrim(F.coalesce(col(x).cast("string"), F.lit("")), F.lit(SPACES))


def name_key(x: Column | str) -> Column:
    """The form in which names are compared: cleaned, lower case."""
    return F.lower(clean(x))


def last_segment(x: Column | str) -> Column:
    """What follows the last dot, without quotes."""
    return F.translate(F.element_at(F.split(col(x), r"\."), -1), "`\"'", "")


def layer(table: Column | str) -> Column:
    """The warehouse layer that a table's prefix names, or the empty text."""
    first = F.substring_index(col(table), "_", 1)
    return F.when(first.isin(*LAYERS), first).otherwise(F.lit(""))


def without_comments(sql: Column | str) -> Column:
    """SQL without line comments, then without block comments."""
    x = col(sql)
    return F.when(x.contains("--") | x.contains("/*"), F.regexp_replace(F.regexp_replace(x, r"(?md)--.*?$", ""), r"(?s)/\*.*?\*/", "")).otherwise(x)


def plain_spaces(sql: Column | str) -> Column:
    x = col(sql)
    return F.when(F.octet_length(x) > F.char_length(x), F.translate(x, WIDE_SPACES, " " * len(WIDE_SPACES))).otherwise(x)


def has_wide_space(sql: Column | str) -> Column:
    return col(sql).rlike(f"[{WIDE_SPACES}]")


def normalised_sql(sql: Column | str) -> Column:
    """No comments, plain single spaces, lower case, nothing at the ends."""
    return F.lower(clean(F.regexp_replace(plain_spaces(without_comments(sql)), r"(?U)\s{2,}|[^\S ]", " ")))


def matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of its group."""
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))


def name_set(names: Column | str) -> Column:
    """Names as a set: keys, blanks dropped, distinct, sorted. Null counts as empty."""
    keys = F.transform(F.coalesce(col(names), F.array().cast("array<string>")), name_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: x != "")))


def filter_set(filters: Column | str) -> Column:
    """Filter texts as a set: lower case, all white space removed, blanks dropped, distinct, sorted."""
    keys = F.transform(F.coalesce(col(filters), F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: x != "")))


def tokens(text: Column | str) -> Column:
    """Words of ASCII letters, digits and underscores in lower case, then the pairs of neighbours among the text's
    Chinese characters taken together."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    chinese = F.regexp_replace(low, "[^一-鿿]+", "")
    n = F.char_length(chinese)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(chinese, i, F.lit(2)))
    return F.when(n >= 2, F.concat(words, pairs)).otherwise(words)


def bucket(token: Column, dim: int) -> Column:
    """A token's bucket: the first 8 hex digits of its MD5 modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def json_object(text: Column | str) -> Column:
    """The JSON object in a model's answer (bare or in a fenced block), or null if there is none."""
    raw = clean(text)
    block = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    found = F.when(block != "", block).otherwise(raw)
    return F.when(F.json_object_keys(found).isNotNull(), found)


def first_true(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    if not cases:
        return F.lit(otherwise)
    chain = reduce(lambda w, c: w.when(c[0], F.lit(c[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1])))
    return chain.otherwise(F.lit(otherwise))


def joined(items: Column | str) -> Column:
    """An array as one text."""
    return F.concat_ws("|", col(items))
