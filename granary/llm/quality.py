"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation-maximisation estimates, from the votes
alone, how often each rule is right on good and on bad documents and the share of good ones. It works on the counts of
the vote patterns: at most 3 to the number of rules, whatever the corpus. A document is kept by its posterior
probability of being good, so that no single rule decides, after base limits that hold whatever the rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

BLANKS = " \t\n\x0b\x0c\r"
RULES = ("repeats", "symbols", "lines", "capitals", "length", "variety", "stops", "letters")
#: EM: rounds; where a document with no bad vote starts, and what each bad vote takes from that; added to every count.
ROUNDS, CLEAN, EACH, SMOOTH = 25, 0.95, 0.4, 1.0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per text, one row per row of docs. A null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda drop: F.char_length(F.regexp_replace("text", drop, "")).cast("long")  # noqa: E731  what remains of a text
    trimmed = F.btrim("text", F.lit(BLANKS))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"\P{Lu}+").alias("n_capitals"),
        left(r"[^.!?]+").alias("n_stops"),
    )
    size = lambda x: F.size(x).cast("long")
    counted = base.select(
        "doc_id",
        "words",
        "n_symbols",
        "n_capitals",
        "n_stops",
        size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        size("lines").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        size(F.array_distinct("words")).alias("n_distinct"),
        size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).alias("n_lettered"),
    )
    return repeated_words(counted).drop("words")


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that occur twice or more in the text, the first occurrence included.

    Texts whose window hashes all differ are done. In the others the windows, each closed by its position, are sorted,
    so that equal ones become neighbours; neighbours are compared as text, and the words they cover are counted once.
    """
    n = F.col("n_words")
    at = lambda i, k: F.element_at("words", i + k)
    starts = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)).cast("int"))
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    keyed = F.transform(starts, lambda i: F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2), F.lpad(i.cast("string"), 10, "0")))
    split = lambda w: F.struct(F.substring_index(w, " ", 3).alias("w"), F.substring_index(w, " ", -1).cast("int").alias("i"))
    nothing = F.array().cast("array<struct<w:string,i:int>>")
    many = F.when(n < 4, False).otherwise(F.size(F.array_distinct(hashes)) < n - 2)
    df = df.withColumn("windows", F.when(many, F.transform(F.sort_array(keyed), split)).otherwise(nothing))
    rest = F.slice("windows", 2, F.greatest(F.size("windows") - 1, F.lit(0)))
    span = lambda i: F.array(i, i + 1, i + 2)
    pairs = F.zip_with("windows", rest, lambda x, y: F.when(x["w"] == y["w"], F.concat(span(x["i"]), span(y["i"]))))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))).cast("long")).drop("windows")


def votes() -> Column:
    """The rules' votes on the counts of features(), in the order of RULES; in integers, so that no rounding decides."""
    c, n = F.col, F.col("n_words")
    rule = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return F.array(
        rule(10 * c("n_repeat_words") > 3 * n, 10 * c("n_repeat_words") <= n),
        rule(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        rule(10 * c("n_dup_lines") > 3 * c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        rule(100 * c("n_capitals") > 30 * c("word_chars"), 100 * c("n_capitals") <= 12 * c("word_chars")),
        rule((10 * c("word_chars") > 75 * n) | (10 * c("word_chars") < 35 * n), (10 * c("word_chars") >= 40 * n) & (10 * c("word_chars") <= 65 * n)),
        rule(100 * c("n_distinct") < 25 * n, 100 * c("n_distinct") >= 40 * n),
        rule((2 * c("n_stops") > n) | ((200 * c("n_stops") < n) & (n >= 100)), (100 * c("n_stops") >= 3 * n) & (100 * c("n_stops") <= 30 * n)),
        rule(100 * c("n_lettered") < 75 * n, 100 * c("n_lettered") >= 90 * n),
    )


def posteriors(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """EM over (votes, n), a row per pattern: adds p_good, the posterior probability of a good document.

    The patterns meet in one row; with 8 rules they are 6,561 at most. Abstentions carry no weight. State of a round:
    the share of good documents, and per rule the chance of a good vote on good (g) and on bad (b) documents.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rule_ids = F.sequence(F.lit(0), F.lit(len(RULES) - 1))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def e_step(s: Column) -> Column:
        logs = lambda p: add(F.zip_with(p["votes"], s["rules"], lambda v, r: F.when(v > 0, F.log(r["g"] / r["b"])).when(v < 0, F.log((1 - r["g"]) / (1 - r["b"]))).otherwise(0.0)))
        return F.transform("ps", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (1 / (1 + F.exp(-(F.log(s["good"] / (1 - s["good"])) + logs(p))))).alias("p")))

    def m_step(w: Column) -> Column:
        total = lambda part: add(F.transform(w, part))
        def chance(j: Column, of: object) -> Column:
            up = total(lambda x: F.when(F.get(x["votes"], j) > 0, x["n"] * of(x)).otherwise(0.0))
            any_vote = total(lambda x: F.when(F.get(x["votes"], j) != 0, x["n"] * of(x)).otherwise(0.0))
            return (up + SMOOTH) / (any_vote + 2 * SMOOTH)
        good, n = total(lambda x: x["n"] * x["p"]), total(lambda x: x["n"])
        rules = F.transform(rule_ids, lambda j: F.struct(chance(j, lambda x: x["p"]).alias("g"), chance(j, lambda x: 1 - x["p"]).alias("b")))
        return F.struct(((good + SMOOTH) / (n + 2 * SMOOTH)).alias("good"), rules.alias("rules"))

    first = F.transform("ps", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (F.lit(CLEAN) * F.pow(F.lit(EACH), F.size(F.filter(p["votes"], lambda v: v < 0)))).alias("p")))
    one = patterns.select(F.struct("votes", F.col("n").cast("double").alias("n")).alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    final = F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), m_step(first), lambda s, _: let(e_step(s), m_step))
    solved = one.withColumn("state", final).select(F.explode(e_step(F.col("state"))).alias("x"))
    return solved.select("x.votes", F.col("x.p").alias("p_good"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, votes).

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: not base_failed, and a posterior
    of threshold at least. Null and empty texts have no words, hence fail the base limits; repeated rows are judged
    alike; null ids are kept as they are; an empty table gives an empty result. Whole texts count, however long. Other columns
    aren't read, whatever their names.
    """
    counted = written(features(docs, id_col, text_col).withColumn("votes", votes()), "features")
    solved = posteriors(counted.groupBy("votes").agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.join(F.broadcast(solved), "votes")  # 3 ** len(RULES) rows at most
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("p_good") >= threshold)).alias("kept"),
        F.round("p_good", 6).alias("p_good"),
        F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"),
    )
