"""Removal of repeated passages against brute force over all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from granary.llm import repeats

SCHEMA = "doc_id long, text string, row int, z string, batch int"


def plain(docs, length):
    """Documents in order: (doc_id, n_bytes, n_removed, n_spans, sha of what stays)."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone[:-1], strict=True) if not g)
        out.append((doc_id, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if gone.any() else None))
    return collections.Counter(out)


def got(spark, docs, **options):
    rows = spark.createDataFrame([(d, t, 1, "z", 2) for d, t in docs], SCHEMA).coalesce(1)
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"]) if r["kept"] is not None else None) for r in repeats.deduplicate(rows, **options).collect())


def made(seed, n=60):
    """Texts that share passages of about the length, with changes, in hot and rare places."""
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcdé \n") for _ in range(k))
    passages = [text(rnd.choice([99, 100, 101, 130, 180, 400])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a, b = sorted(rnd.sample(range(len(p) + 1), 2)) if rnd.random() < 0.4 else (0, len(p))
            parts += [text(rnd.randrange(80)), p[a:b]]
        docs.append((i, "".join(parts)))
    docs[3] = (3, docs[2][1])
    docs[5] = (5, "x" * 700 + docs[4][1] + "x" * 300)
    docs[7] = (7, "ab" * 400)
    docs[8] = (8, "\x00" * 250 + "a" + "\x00" * 120)
    return docs


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"batches": 1}), (3, {"batches": 7, "bucket_bytes": 2000}), (4, {"hot": 1, "batches": 3}), (5, {"hot": 3, "bucket_bytes": 3000}), (6, {"length": 60, "batches": 2})])
def test_equals_brute_force(spark, seed, options):
    docs = made(seed)
    random.Random(seed).shuffle(docs)
    assert got(spark, docs, **options) == plain(sorted(docs), options.get("length", 100))


def test_odd_rows(spark):
    same = "the same passage, " * 9
    docs = [(None, same), (1, None), (1, ""), (2, same), (2, same), (2, "x" * 99), (3, "x" * 100), (4, "é" * 60), (5, "é" * 49 + "x")]
    assert got(spark, docs) == plain(docs, 100)
    assert not got(spark, []) and got(spark, [(1, None)]) == plain([(1, None)], 100)


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 30_000).astype("u1")
    data[5000:9000] = data[20_000:24_000]
    data[12_000:13_000] = 97
    offsets = np.array([0, 10, 10, 4000, 4099, 4200, 19_000, 30_000])
    for step in (500, 1 << 20):
        places, first, last, _ = repeats.anchors(data, offsets, 100, step)
        owner = {}
        for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
            for w in range(a, b + 1):
                assert w not in owner and 0 <= p - w <= 100 - repeats.HEAD
                owner[w] = p - w
        want = [w for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for w in range(a, b - 99)]
        assert sorted(owner) == want
        by = collections.defaultdict(set)
        for w, o in owner.items():
            by[data[w : w + 100].tobytes()].add(o)
        assert all(len(x) == 1 for x in by.values()) and len(by) < len(owner)
        assert len(places) < 1000 + 30_000 / 30


def test_levels_merge_like_a_counter(spark):
    """Equal-sized levels merge; what was indexed already isn't indexed again."""
    docs = spark.createDataFrame([(i, "".join(random.Random(i % 40).choice("abcdefgh ") for _ in range(600))) for i in range(80)], "doc_id long, text string")
    texts = repeats.stored(docs, "doc_id", "text", 8)
    levels, sizes = repeats.Levels(2), []
    for b in range(8):
        levels.add(texts.filter(f"batch = {b}").select("row", "z"))
        sizes.append(sorted(levels.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2], [3]]
    held = [repeats.opened(r, *repeats.SUFFIX) for r in levels.levels[3].toArrow().column("blob")]
    keys = np.concatenate([x[0] for x in held])
    assert len(np.unique(keys)) == len(keys) and all((np.diff(x[0].astype("i8")) > 0).all() for x in held)


def test_a_passage_of_most_documents_is_one_suffix_a_slice(spark):
    passage = "".join(random.Random(7).choice("abcdefgh ") for _ in range(300))
    docs = [(i, f"{i} own words {i * 7919} " + passage) for i in range(400)]
    texts = repeats.stored(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text", 1)
    blobs = repeats.suffixes(texts.coalesce(1), 1, 100).filter("bucket = 0").collect()
    assert sum(len(repeats.opened(repeats.pa.scalar(bytes(r["blob"])), *repeats.SUFFIX)[0]) for r in blobs) < 1000
    assert got(spark, docs) == plain(docs, 100) == got(spark, docs, hot=10)
