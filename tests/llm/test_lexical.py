"""Ranked lexical search against a plain scorer."""

import collections
import math
import re

import pytest

from granary.llm import lexical

SCHEMA, ITEMS = "doc_id long, text string, m int, n string, chunk int", "item_id long, text string, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return collections.Counter(out)


def got(spark, docs, items, chunk=lexical.CHUNK, **options):
    left = spark.createDataFrame([(d, t, 1, "a", 2) for d, t in docs], SCHEMA).repartition(3)
    index = lexical.build(left, chunk=chunk)
    found = lexical.search(index, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), **options)
    return collections.Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.fixture(scope="module")
def texts(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").limit(12).collect()]


@pytest.mark.parametrize("chunk", [200, 5000, lexical.CHUNK])
def test_equals_a_plain_scorer(spark, texts, chunk):
    docs, items = texts
    assert got(spark, docs, items, chunk) == plain(docs, items)


def test_blocks_of_queries(spark, texts):
    docs, items = texts
    items = [*items, (99, "x " + " ".join(t for _, t in items)), (items[0][0], items[0][1])]  # a long one, a repeated one
    assert got(spark, docs[:60], items, 500, block=3, block_terms=40) == plain(docs[:60], items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "Äpfel ÄPFEL äpfel"), (5, "a1 b2"), (5, "a1 b2"), (None, "a1 b2"), (None, "A1"), (6, "日本 ½ x\x00y"), (7, "a1 " * 3000), (8, "same"), (9, "same"), (10, "same")]
    items = [(1, "a1"), (2, "ÄPFEL äpfel"), (3, None), (4, ""), (5, "unknown"), (6, "same same SAME"), (None, "b2 x y 日本"), (7, "½")]
    assert got(spark, docs, items, 3) == plain(docs, items)
    assert got(spark, docs, items, 3, k=1) == plain(docs, items, 1)


def test_empty_tables(spark):
    assert not got(spark, [], [(1, "a")]) and not got(spark, [(1, "a"), (2, None)], [])
    assert not got(spark, [(1, None)], [(1, "a")])


def test_a_stratum_of_most_rows_is_cut(spark):
    docs = [(i, f"common word{i % 50} w{i}") for i in range(2000)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), chunk=600)
    assert index.chunks.count() >= 8 and index.chunks.agg({"n_docs": "max"}).first()[0] < 600
    items = [(1, "common word7"), (2, "w1999 common")]
    assert got(spark, docs, items, 600) == plain(docs, items)


def test_chunks_under_the_bound_are_not_visited(spark, monkeypatch):
    docs = [(i, " ".join(f"x{i}y{j}" for j in range(40)) + " rare") for i in range(40)] + [(100, "rare rare rare"), (101, "rare rare")]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), chunk=100)
    block = lexical.Block(["rare"], lexical.np.array([5]), [lexical.np.array([0])])
    bounds = index.chunks.toArrow().to_batches()
    high = [int(block.bounds(b, r)[1][0]) for b in bounds for r in range(b.num_rows)]
    assert min(high) < 5 * (1_000_000_000 * 2 // (2000 + 8 * 100))  # chunks of long documents can't reach the short one
    items = [(1, "rare")]
    assert got(spark, docs, items, 100, k=1) == plain(docs, items, 1)
