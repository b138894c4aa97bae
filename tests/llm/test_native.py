"""Quality rules, sharding, mixing and exact dedup on small tables, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import exact_dedup, mixing, quality, sharding

SCHEMA = "doc_id long, text string, source string, kept string, shard int, n_words int"
LONG = " ".join(f"w{i % 700}" for i in range(9000))
ROWS = [
    (1, "a b\tc", "s1"),
    (2, "a  b c", "s1"),
    (3, None, None),
    (4, "", "s2"),
    (None, "a b c", "s1"),
    (5, LONG, "s1"),
    (6, LONG.replace(" ", "\n"), "s2"),
    (7, "x", None),
    (7, "x", None),
    (8, "é 日本 \x00 y", "s1"),
    (9, " ", "s1"),
    (10, "a b c a b c a b c " * 30, "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in ROWS], SCHEMA).repartition(3).cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_classes(docs, bits):
    """bits=3: nearly every identifier is shared by different chunks, and the classes stay right."""
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    got = rows(exact_dedup.exact_classes(docs, mean_words=2, id_bits=bits))
    assert len(got) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        members = groups[by_sha[r["text_sha256"]]]
        keep = min((m for m in members if m is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), r["doc_id"] == keep)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in ROWS)


def test_chunks_determine_the_text(spark):
    texts = ["a b", "a b ", "a\x00b", "a \x00b", "a", "", " ", "a \x00", "b a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t"), 1).alias("a"), exact_dedup.chunks(F.col("t"), 2).alias("b"))
    got = df.collect()
    for c in "ab":
        assert len({tuple(r[c]) for r in got}) == len(texts)


def features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, spark, small):
    extra = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(extra)
    texts = collections.Counter(features(r["text"]) for r in both.collect())
    got = rows(quality.quality(both))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == texts
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def em(patterns, rounds):
    q = {v: quality.CLEAN * quality.EACH ** sum(x < 0 for x in v) for v in patterns}
    for _ in range(rounds):
        n = sum(patterns.values())
        good = (sum(patterns[v] * q[v] for v in patterns) + 1) / (n + 2)
        g, b = [], []
        for j in range(len(quality.RULES)):
            for out, w in ((g, lambda v: q[v]), (b, lambda v: 1 - q[v])):
                up = sum(patterns[v] * w(v) for v in patterns if v[j] > 0)
                voted = sum(patterns[v] * w(v) for v in patterns if v[j])
                out.append((up + 1) / (voted + 2))
        for v in patterns:
            s = math.log(good / (1 - good)) + sum(math.log(g[j] / b[j]) if x > 0 else math.log((1 - g[j]) / (1 - b[j])) for j, x in enumerate(v) if x)
            q[v] = 1 / (1 + math.exp(-s))
    return q


def test_em(spark):
    patterns = {(1,) * 8: 700, (-1, 1, 1, 1, 1, 1, 1, 1): 20, (-1, -1, 0, 1, 1, 1, 1, 0): 50, (1, 0, 0, 0, 0, 1, 1, 1): 90, (0,) * 8: 3}
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
    want = em(patterns, quality.ROUNDS)
    for r in quality.posteriors(df).collect():
        assert r["p_good"] == pytest.approx(want[tuple(r["votes"])], abs=1e-9)


def score(key, i, weight):
    u = (int(hashlib.md5(f"shard:{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return -math.log(u) / weight


def test_shards(docs):
    weights = (1.0, 2.0, 1.0)
    got = rows(sharding.shard(docs, weights, grown=1.5, buckets=4))
    assert len(got) == len(ROWS)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        order = sorted((score(key, i, w), i) for i, w in enumerate((*weights, 1.5)))
        assert r["grown_shard"] == order[0][1]
        assert r["shard"] == next(i for _, i in order if i < 3)
        assert r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_weights(spark):
    got = sharding.shard(spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), (1.0, 3.0)).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in got}[1] == pytest.approx(6000, abs=200)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), (1.0, 0.0))


def poisson(rate, key, seed="m"):
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        p = c = math.exp(-rate / parts)
        k = 0
        while c < u:
            k += 1
            p *= rate / parts / k
            c += p
            total += 1
    return total


@pytest.mark.parametrize("by_bytes", [False, True])
def test_mix(docs, by_bytes):
    weights = {"s1": 3.0, "s2": 0.0, "s3": 40.0}
    got = rows(mixing.mix(docs, weights, 2.0, epochs=2.0, by_bytes=by_bytes, seed="m"))
    mass = collections.Counter()
    for _, t, s in ROWS:
        mass[s] += len((t or "").encode()) if by_bytes else 1
    share = {s: weights.get(s, 2.0) for s in mass}
    want = collections.Counter()
    for i, t, s in ROWS:
        rate = share[s] / sum(share.values()) * sum(mass.values()) * 2.0 / mass[s] if mass[s] else 0.0
        want[i, t] += poisson(rate, "" if i is None else str(i))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == +want
    assert set(got[0]) == {*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "copy_no", "mix_key"}


def test_mix_rates_hold_at_scale(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15000, "a").when(F.col("id") < 19990, "b").otherwise("c").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"a": 1.0, "b": 1.0, "c": 1.0}).groupBy("source").count().collect()}
    assert all(v == pytest.approx(20000 / 3, rel=0.05) for v in got.values()), got


def test_lookup_join_has_a_way_past_broadcast(spark):
    from granary.llm.common import lookup_join

    left = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3)], "k string, salt int")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    for n in (1, 10**9):
        assert sorted(map(str, lookup_join(left, right, "k", n).select("k", "salt", "v").collect())) == sorted(map(str, left.join(right, "k", "left").select("k", "salt", "v").collect()))


def test_lookups_beyond_the_limit_are_never_broadcast(spark, monkeypatch):
    """Spark judges a lookup by its files; with a salt's copies of each row the driver once ran out of memory."""
    from granary.llm import common
    from granary.operators import catalog

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    left = common.written(spark.createDataFrame([(i % 7, i) for i in range(40)], "k long, v long"), "left")
    right = common.written(spark.createDataFrame([(i, i * 10, 6) for i in range(5)], "k long, x long, n long"), "right")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    expected = sorted((i, None if i % 7 > 4 else i % 7 * 10) for i in range(40))
    ways = [common.lookup_join(left, right, "k", 5), common.lookup_join(left, right, "k", 5, salts=1), catalog.lookup(left, right, ["k"], False, "v")]
    for found in ways:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        assert sorted((r["v"], r["x"]) for r in found.collect()) == expected
    counted = common.counted_join(left, right, "k", "n")
    assert "SortMergeJoin" in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["v"], r["x"]) for r in counted.collect()) == expected
    rest = common.without(left, right, {"k": "k"})
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["v"] for r in rest.collect()) == [i for i in range(40) if i % 7 > 4]


def test_empty_tables(docs):
    none = docs.filter("doc_id = -1")
    assert exact_dedup.exact_classes(none).count() == 0
    assert quality.quality(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert mixing.mix(none, {"a": 1.0}).count() == 0


def test_quality_against_labels(spark):
    """Of the labelled documents the bad ones go, and nearly all good ones stay."""
    sf = "/root/testdata/sf0.01"
    judged = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "kept")
    found = collections.Counter((r["quality"], r["kept"]) for r in judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect())
    assert found[0, True] <= 0.02 * (found[0, True] + found[0, False])
    assert found[1, True] >= 0.95 * (found[1, True] + found[1, False])


def test_large_groups_are_dealt_in_ranges(spark):
    """Groups beyond range_rows keep gapless slots."""
    rows = [(1, "a")] * 57 + [(2, "b")] * 11 + [(i, "c") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, range_rows=10).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    plain = sharding.shard(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))


def test_counted_join_splits_hot_keys(spark, monkeypatch):
    from granary.llm import common

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(300, None)], "i long, k string")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k3'").withColumn("v", F.concat("k", F.lit("!")))
    want = sorted(map(str, left.join(right, "k", "left").select("i", "k", "v").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert sorted(map(str, common.counted_join(left, right, "k", "n", hot=50).select("i", "k", "v").collect())) == want


def test_a_cluster_names_its_shared_folder(spark):
    from granary.llm import common
    from granary.sources import shared

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    for module in (common, shared):
        with pytest.raises(ValueError):
            module.shared_dir(Cluster)
