"""Table lineage: edges from scripts, and what is reached from given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.facts import one_each
from granary.sources.shared import written


def edges(facts: DataFrame) -> DataFrame:
    """(source, target, n_scripts): a script that inserts into target reads source."""
    each = one_each(facts.select("script_id", "edges"), "edges", "e").select("script_id", "e.source", "e.target")
    return each.groupBy("source", "target").agg(F.countDistinct("script_id").alias("n_scripts"))


def reached(found: DataFrame, starts: DataFrame, upstream: bool = False) -> DataFrame:
    """(start, table_name, depth): the tables downstream (or upstream) of each of starts (start), with the least number
    of steps. Breadth first: a round joins its frontier to the edges and drops what was seen, so that cycles end; each
    frontier is written to the shared folder."""
    a, b = ("target", "source") if upstream else ("source", "target")
    steps = written(found.select(F.col(a).alias("table_name"), F.col(b).alias("to")).filter(F.col(a) != F.col(b)).distinct(), "edges")
    frontier = starts.select("start", F.col("start").alias("table_name"))
    seen: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        new = frontier.join(steps, "table_name").select("start", F.col("to").alias("table_name")).filter("table_name <> start").distinct()
        if seen is not None:
            new = new.join(seen, ["start", "table_name"], "left_anti")
        new = written(new.withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select("start", "table_name")


def jumps(steps: DataFrame) -> DataFrame:
    """(source, target): where each table goes that has one step only; see doubled()."""
    return steps.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").select("source", "target")


def doubled(found: DataFrame) -> DataFrame:
    """Jumps twice as far; those that end where no jump begins stay. What is passed along steps and jumps, round by round,
    goes down a chain in about the logarithm of its length."""
    on = found.select(F.col("source").alias("target"), F.col("target").alias("far"))
    return written(found.join(on, "target", "left").select("source", F.coalesce("far", "target").alias("target")), "jumps")


def spread_least(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(table_name, color): of start (table_name, color) the least color of a table that reaches a table by steps (source,
    target), and its own."""
    back = steps.select(F.col("target").alias("source"), F.col("source").alias("target"))
    now, skips = written(start, "colors"), written(jumps(back), "jumps")
    while True:
        known = now.select(F.col("table_name").alias("target"), "color")
        sent = back.unionByName(skips).join(known, "target").groupBy(F.col("source").alias("table_name")).agg(F.min("color").alias("sent"))
        new = now.join(sent, "table_name", "left").select("table_name", F.least("color", "sent").alias("color"), F.coalesce(F.col("sent") < F.col("color"), F.lit(False)).alias("moved"))
        new = written(new, "colors")
        now = new.select("table_name", "color")
        if new.filter("moved").isEmpty():
            return now
        skips = doubled(skips)


def condensed(found: DataFrame) -> DataFrame:
    """(table_name, component): the strongly connected component of every table, named by its least table.

    By colouring: in a round each table left takes the least name that reaches it; those of a color that reach the color's
    own table backwards, within the color, are its component. Tables that nothing enters or that lead nowhere are
    components by themselves and are peeled off first, so that rounds are few in graphs with few cycles."""
    edges_ = written(found.select("source", "target").filter("source <> target").distinct(), "edges")
    left = written(edges_.select(F.explode(F.array("source", "target")).alias("table_name")).distinct(), "nodes")
    done: DataFrame | None = None
    while not left.isEmpty():
        while True:  # peel
            inner = edges_.select(F.col("target").alias("table_name")).intersect(edges_.select(F.col("source").alias("table_name")))
            core = written(left.join(inner, "table_name", "left_semi"), "core")
            off = left.join(core, "table_name", "left_anti").withColumn("component", F.col("table_name"))
            n_off = left.count() - core.count()
            if n_off:
                done = written(off if done is None else done.unionByName(off), "components")
            keep = core.select(F.col("table_name").alias("source"))
            edges_ = written(edges_.join(keep, "source", "left_semi").join(core.select(F.col("table_name").alias("target")), "target", "left_semi"), "edges")
            left = core
            if not n_off or left.isEmpty():
                break
        if left.isEmpty():
            break
        colors = spread_least(edges_, left.select("table_name", F.col("table_name").alias("color")))
        same = edges_.join(colors.select(F.col("table_name").alias("source"), F.col("color").alias("a")), "source").join(colors.select(F.col("table_name").alias("target"), F.col("color").alias("b")), "target").filter("a = b").select(F.col("target").alias("source"), F.col("source").alias("target"))
        reach = spread_least(written(same, "back"), colors.select("table_name", F.when(F.col("table_name") == F.col("color"), 0).otherwise(1).alias("color")))
        part = reach.filter("color = 0").select("table_name").join(colors, "table_name").select("table_name", F.col("color").alias("component"))
        done = written(part if done is None else done.unionByName(part), "components")
        left = written(left.join(part, "table_name", "left_anti"), "nodes")
        edges_ = written(edges_.join(left.select(F.col("table_name").alias("source")), "source", "left_semi").join(left.select(F.col("table_name").alias("target")), "target", "left_semi"), "edges")
    return left.select("table_name", F.col("table_name").alias("component")) if done is None else done


def sketch_sizes(found: DataFrame, k: int = 64, upstream: bool = False) -> DataFrame:
    """(table_name, n_reached, exact): how many other tables each table reaches downstream (or upstream), without a list of
    all pairs.

    Tables get a hash as rank; a component's sketch is the k least ranks of what it reaches, passed against the edges of the
    condensed graph. Fewer than k are counted exactly; k give the estimate (k - 1) / (the k-th rank), whose relative error
    is about 1 / sqrt(k - 2). A round passes sketches along all edges and along jumps over chains, which double; it ends when
    no sketch changes."""
    a, b = ("target", "source") if upstream else ("source", "target")
    part = written(condensed(found), "condensed")
    rank = F.conv(F.substring(F.md5("table_name"), 1, 13), 16, 10).cast("long")
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(c))), 1, k)
    own = part.groupBy("component").agg(F.array_sort(F.collect_list(rank)).alias("all"))
    now = written(own.select("component", F.slice("all", 1, k).alias("s")), "sketches")
    named = lambda c, to: part.select(F.col("table_name").alias(c), F.col("component").alias(to))
    steps = found.select(F.col(a).alias("x"), F.col(b).alias("y")).join(named("x", "p"), "x").join(named("y", "q"), "y").select("p", "q").filter("p <> q").distinct()
    steps = written(steps.select(F.col("p").alias("source"), F.col("q").alias("target")), "steps")
    skips = written(jumps(steps), "jumps")
    while True:
        known = now.select(F.col("component").alias("target"), "s")
        sent = steps.unionByName(skips).join(known, "target").groupBy(F.col("source").alias("component")).agg(F.collect_list("s").alias("sent"))
        new = now.join(sent, "component", "left").select("component", F.col("s").alias("had"), least(F.concat(F.array("s"), F.coalesce("sent", F.array().cast("array<array<bigint>>")))).alias("s"))
        new = written(new, "sketches")
        if new.filter("had <> s").isEmpty():
            break
        now, skips = new.select("component", "s"), doubled(skips)
    n = F.size("s")
    count = F.when(n < k, n.cast("double")).otherwise((k - 1) * float(16**13) / F.element_at("s", k))
    sizes = part.join(now.select("component", count.alias("count"), (n < k).alias("exact")), "component")
    return sizes.select("table_name", F.round(F.col("count") - 1, 6).alias("n_reached"), "exact")
