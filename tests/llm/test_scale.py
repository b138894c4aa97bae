"""Long chains, hot keys, hostile pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from granary.llm import common, exact_dedup, html_mincut, near_sets, simhash

PROSE = "One sentence here that is long enough to be prose, surely. Another one follows it, and it ends."


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 10_000, []
    monkeypatch.setattr(simhash, "written", lambda df, name: tables.append(name) or common.written(df, name))
    ends = spark.range(1, n).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = simhash.components(ends.union(spark.createDataFrame([(n + 5, n + 9), (n + 9, n + 7)], "a long, b long")))
    assert got.groupBy("label").count().collect() == [] or {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: n, n + 5: 3}
    assert len(tables) <= 20


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def joined_by_hand(left, right):
    return sorted(map(str, left.join(right, ["k", "m"], "left").select("i", "k", "m", "v").collect()))


def test_the_hottest_keys_are_split_though_many_are_hot(spark):
    left = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.lit(1).alias("m"))
    right = left.groupBy("k", "m").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = common.counted_join(left, right, ["k", "m"], "n", hot=10, most=4)
    assert sorted(map(str, out.select("i", "k", "m", "v").collect())) == joined_by_hand(left, right)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_hot_keys_past_the_broadcast_limit(spark, monkeypatch):
    """Exact classes and met() with a key of a third of the rows, when nothing may be broadcast whole."""
    docs = spark.createDataFrame([(i, "one text for all" if i % 3 == 0 else f"text {i // 2}") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.exact_classes(docs).collect()))
    fps = spark.createDataFrame([(i, i % 7 if i % 3 == 0 else i * 1_000_003) for i in range(200)], "doc_id long, fp long")
    near = sorted(map(tuple, simhash.classes(fps, block=20).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, exact_dedup.exact_classes(docs).collect())) == want
    assert sorted(map(tuple, simhash.classes(fps, block=20).collect())) == near


def test_large_components_keep_every_link(spark, monkeypatch):
    """A component of many near copies with sets outside its largest class, in blocks against one block."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    import corpus_pipeline
    from tests.llm.test_pipeline import plain_classes

    roots = plain_classes(rows)
    want = {rows[k][0] for k in range(len(rows)) if roots[k] == k}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 1 < len(want) < 140
    for size in (near_sets.BLOCK_SETS, 25, 7):
        monkeypatch.setattr(near_sets, "BLOCK_SETS", size)
        assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


@pytest.mark.parametrize("tag", ["option", "button", "select", "iframe", "template", "noscript", "svg", "div", "p", "video"])
def test_hostile_pages_take_time_in_proportion(tag):
    page = f"<article><p>{PROSE}</p>" + f"<{tag}>x " * (1_000_000 // (len(tag) + 4)) + "</article>"
    start = time.process_time()
    assert html_mincut.main_text(page).startswith(PROSE)
    assert time.process_time() - start < 6


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><div class="content social"><p>{PROSE}</p></div></article>', PROSE),
        (f'<main><section id="form"><h2>The form</h2><p>{PROSE}</p></section><p>{PROSE}</p></main>', f"The form\n{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><noscript>Please enable JavaScript to read this page.</noscript></article>", PROSE),
        (f"<article><p>{PROSE}</p><video controls>Your browser has no video.</video><audio>Nor audio.</audio></article>", PROSE),
        (f"<article><p>{PROSE}</p></article><div class=comments><p>{PROSE * 9}</p></div>", PROSE),
        (f"<select><option>a</select><article><p>{PROSE}</p></article><select><option>b</option></select>", PROSE),
        (f"<article><p>{PROSE}</p><select><option>one<option>two</select></article>", PROSE),
        (f'<div style="display:none"><p>{PROSE}</p></div>', ""),
    ],
)
def test_parts_of_pages(page, text):
    assert html_mincut.main_text(page) == text
