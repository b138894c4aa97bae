"""Removal of repeated passages by a logarithmic family of sparse suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier. Every such string, a window, is assigned to
an anchor inside it: the leftmost place where the hash of the next HEAD bytes is least in the window. Equal windows have
their anchors at one place, so that only suffixes from anchors are indexed, about one in length / 3. An array holds its
suffixes in the order of a hash of their heads, each as a pointer to its text.

Batches of documents, in their order, get such arrays. A batch's array is scanned side by side with those of all levels;
suffixes whose head stands in either are candidates. It is then merged with the levels of its size, as a binary counter
counts, so that n batches keep about log n arrays. Last, candidates of a head come together with the text around them and
are sorted there as a suffix array proper: neighbours' common prefixes, to the right and to the left, leave only windows
that can occur twice, and those are compared exactly with the first that they equal.
"""

from __future__ import annotations

import hashlib
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, counted_join, new_path, sized, written

#: Bytes of a window and of an anchor's head.
LENGTH, HEAD = 100, 32
#: Batches that a whole table is cut into; bytes of text that one bucket of suffixes or of candidates stands for, about.
BATCHES, BUCKET_BYTES = 4, 4 << 20
#: Candidates of one head beyond which their windows are compared by a shuffle, not in one task.
HOT = 200_000
#: Odd multipliers of the rolling hashes.
_ODD = [np.uint64(xxhash.xxh64_intdigest(b"repeats %d" % i) | 1) for i in range(8)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _ODD[6]
    return x ^ x >> np.uint64(29)


def head_hashes(data: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the HEAD bytes from each place on."""
    if len(data) < HEAD:
        return np.zeros(0, "u8")
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()  # eight bytes from each place on
    a = words[:-24] * _ODD[0] + (words[8:-16] ^ words[8:-16] >> np.uint64(32)) * _ODD[1]
    b = words[16:-8] * _ODD[2] + (words[24:] ^ words[24:] >> np.uint64(32)) * _ODD[3]
    return mixed(a ^ (b >> np.uint64(29)) * _ODD[4] ^ b)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, last, hashes) of texts that stand one after another in data, from offsets[i] to offsets[i + 1]: the
    anchors, the first and the last window that each has, and the hash of its head. No window crosses texts."""
    span, found = length - HEAD + 1, []
    inside = np.zeros(len(data) + 1, "i1")  # 1 where a window of one text starts
    sizes = np.diff(offsets)
    long = sizes >= length
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype="i1").astype(bool)
    for at in range(0, len(data) - length + 1, step):
        heads = head_hashes(data[at : at + step + length - 1])
        # The least of each window: 40 bits of hash, then the place.
        least = heads & ~np.uint64((1 << 24) - 1) | np.arange(len(heads), dtype="u8")
        k = 1
        while 2 * k <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < span:
            least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
        window = np.flatnonzero(inside[at : at + len(least)])
        place = (least[window] & np.uint64((1 << 24) - 1)).astype("i8")
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, "i8")
        ends = np.append(starts[1:], len(place)) - 1 if len(place) else starts
        found.append((place[starts] + at, window[starts] + at, window[ends] + at, heads[place[starts]]))
    places, first, last, hashes = (np.concatenate(x) if found else np.zeros(0, "i8") for x in zip(*found, strict=True)) if found else (np.zeros(0, "i8"),) * 4
    twice = np.flatnonzero(places[1:] == places[:-1])  # an anchor whose windows two steps share
    last[twice] = last[twice + 1]
    keep = np.ones(len(places), bool)
    keep[twice + 1] = False
    return places[keep], first[keep], last[keep], hashes[keep].astype("u8")


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string of bytes: their sizes first."""
    import zstandard

    sizes = np.array([x.nbytes for x in arrays], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(sizes)], "<i8").tobytes(), sizes.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)]))


def opened(blob: pa.Scalar, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    starts = 8 * (1 + len(kinds)) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, int(at)) for kind, n, at in zip(kinds, sizes, starts, strict=False)]


def joined(columns: list[list[np.ndarray]], *kinds: str) -> list[np.ndarray]:
    return [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0, k) for i, k in enumerate(kinds)]


def runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values starts and stops."""
    cuts = np.flatnonzero(np.diff(sorted_values.astype("i8"), prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(sorted_values)], strict=False))


def stored(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(batch, row, doc_id, n_bytes, sha, z): each text compressed, a number for its row, and the batch by ascending id,
    null ids in the first. Written in buckets of row, so that joins on row move no text again."""
    spark = docs.sparkSession
    cuts = [c for c in docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or []] if batches > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in (s for b in batches for s in sized(b, "text", 8 << 20)):
            texts = [x.as_buffer() if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary())]
            sizes = pa.array([len(memoryview(x)) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("batch", "row", "doc_id")), sizes, pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([press.compress(x) for x in texts], pa.binary())], ["batch", "row", "doc_id", "n_bytes", "sha", "z"])

    doc_id = F.col(id_col).cast("long")
    batch = sum((F.when(doc_id > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = docs.select(batch.cast("int").alias("batch"), F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "batch int, row long, doc_id long, n_bytes long, sha string, z binary")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"granary_{uuid.uuid4().hex}"
    out.repartition(n, "row").write.partitionBy("batch").bucketBy(n, "row").option("path", new_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def unpressed(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of a batch's z, in slices of about size bytes: (from, to, bytes, offsets)."""
    import zstandard

    press, at, had = zstandard.ZstdDecompressor(), 0, []
    total = 0
    for i, z in enumerate(batch.column("z")):
        had.append(press.decompress(z.as_buffer()))
        total += len(had[-1])
        if total >= size or i == batch.num_rows - 1:
            yield at, i + 1, np.frombuffer(b"".join(had), "u1"), np.concatenate([[0], np.cumsum([len(x) for x in had])]).astype("i8")
            at, had, total = i + 1, [], 0


#: Suffix pointers: key is 32 bits of the head's hash, known whether the suffix is a candidate already; at packs the
#: anchor's place and how far before it its first and last window start.
SUFFIX = ("<u4", "<i8", "<i8", "u1")


def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 16 | (place - first) << 8 | (place - last)


def suffixes(texts: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """(bucket, level, blob): the sorted suffixes of each slice of texts by bucket, level -1. Of those in a slice that share
    a head one stands for all, and all are candidates: their pointers go under a negative bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for a, b, data, offsets in unpressed(batch):
                places, first, last, hashes = anchors(data, offsets, length)
                doc = np.searchsorted(offsets, places, side="right") - 1
                row, at = rows[a:b][doc], packed(places - offsets[doc], first - offsets[doc], last - offsets[doc])
                bucket, key = (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
                head = bucket << np.uint64(32) | key
                _, one, of, count = np.unique(head, return_index=True, return_inverse=True, return_counts=True)
                again = count[of] > 1
                out = [(-1 - int(rows[a]), squeezed(head[again].astype("<u8"), row[again], at[again]))] if again.any() else []
                for i, j in runs(bucket[one]):
                    some = one[i:j]
                    out.append((int(bucket[some[0]]), squeezed(key[some].astype("<u4"), row[some], at[some], (count[i:j] > 1).astype("u1"))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([-1] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "level", "blob"])

    return texts.select("row", "z").mapInArrow(run, "bucket long, level int, blob binary")


def scan(merged: list[int], keep: bool) -> object:
    """A task's work on a bucket: the batch's array against those of the levels. Returns candidates (kind 0), and the array
    (kind 1) of suffixes whose head was not indexed yet, merged with the levels that are named."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kind = [("kind", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())]
        if bucket < 0:
            blobs = table.column("blob").combine_chunks()
            return pa.table([pa.array([0] * len(blobs), pa.int32()), table.column("bucket"), blobs], schema=pa.schema(kind))
        levels: dict[int, list[list[np.ndarray]]] = {}
        for level, blob in zip(table.column("level").to_pylist(), table.column("blob"), strict=True):
            levels.setdefault(level, []).append(opened(blob, *SUFFIX))
        arrays = {}
        for level, parts in levels.items():
            key, row, at, known = joined(parts, *SUFFIX)
            order = np.argsort(key, kind="stable")  # sorted runs: a merge
            arrays[level] = [key[order], row[order], at[order], known[order].copy()]
        key, row, at, known = arrays.pop(-1, [np.zeros(0, k) for k in SUFFIX])
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        found = ~new  # of a head that several slices have, all are candidates
        found[:-1] |= ~new[1:]
        out = []

        def emit(key: np.ndarray, row: np.ndarray, at: np.ndarray) -> None:
            out.append((0, squeezed(np.uint64(bucket << 32) | key.astype("<u8"), row, at)))

        for other in arrays.values():
            place = np.searchsorted(other[0], key)
            hit = place < len(other[0])
            hit[hit] = other[0][place[hit]] == key[hit]
            found |= hit
            new &= ~hit
            theirs = np.unique(place[hit])
            theirs = theirs[other[3][theirs] == 0]
            emit(other[0][theirs], other[1][theirs], other[2][theirs])
            other[3][theirs] = 1
        mine = found & (known == 0)
        emit(key[mine], row[mine], at[mine])
        if keep:
            known = known | found.astype("u1")
            key, row, at, known = joined([[x[new] for x in (key, row, at, known)], *(arrays[m] for m in merged if m in arrays)], *SUFFIX)
            order = np.argsort(key, kind="stable")
            out.append((1, squeezed(key[order], row[order], at[order], known[order])))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], schema=pa.schema(kind))

    return run


class Levels:
    """The family of arrays over batches that were added: a level of size 2^i holds that many batches."""

    def __init__(self, n_buckets: int, length: int = LENGTH) -> None:
        self.n_buckets, self.length = n_buckets, length
        self.levels: dict[int, DataFrame] = {}

    def add(self, texts: DataFrame, keep: bool = True) -> DataFrame:
        """Scan a batch of texts (row, z) against all levels and merge it into the family, if that is to be kept. Returns
        blobs of the candidates, the batch's and those of the levels that it meets first."""
        rows = suffixes(texts, self.n_buckets, self.length)
        for level, array in self.levels.items():
            rows = rows.unionByName(array.select("bucket", F.lit(level).alias("level"), "blob"))
        size = 0
        while size in self.levels:
            size += 1
        done = written(rows.groupBy("bucket").applyInArrow(scan(list(range(size)), keep), "kind int, bucket long, blob binary"), "scanned")
        for merged in range(size):
            self.levels.pop(merged)
        if keep:
            self.levels[size] = done.filter("kind = 1").select("bucket", "blob")
        return done.filter("kind = 0").select("blob")


def pointers(blobs: DataFrame) -> DataFrame:
    """(head, row, at) of blobs of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                head, row, at = opened(blob, "<i8", "<i8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(row), pa.array(at)], ["head", "row", "at"])

    return blobs.mapInArrow(run, "head long, row long, at long")


#: What comes to a bucket of candidates: head, id (least for null), row, at, and the bytes of all windows of the anchor.
CONTEXT = ("<i8", "<i8", "<i8", "<i8", "u1")
SPAN = "row long, start long, stop long"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them), for all i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, o2, o1) of packed pointers: windows start from o2 to o1 before the place."""
    return at >> 16, at >> 8 & 255, at & 255


def contexts(texts: DataFrame, length: int, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """Of texts (row, doc_id, z, x): (bucket, blob) of candidates with the text around them, by head. Equal ones of a slice are
    taken once, the first; spans of the others go under negative buckets. Of hot heads there are windows instead, (w,
    doc_id, row, start), w the digest of a window. A slice's choice isn't the same if it is made again: use it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            ids = pc.fill_null(batch.column("doc_id"), -(1 << 63)).to_numpy()
            for a, b, data, offsets in unpressed(batch):
                lists = batch.column("x").slice(a, b - a)
                doc = np.repeat(np.arange(b - a), pc.list_value_length(lists).to_numpy())
                head, at = (lists.flatten().field(c).to_numpy() for c in ("head", "at"))
                order = np.lexsort((at, rows[a:b][doc], ids[a:b][doc]))
                doc, head, at = doc[order], head[order], at[order]
                is_hot = np.isin(head, hot)
                place, o2, o1 = windows_of(at)
                start, size = offsets[doc] + place - o2, length + o2 - o1
                view, text = memoryview(data), {}
                first = np.array([text.setdefault(bytes(view[s : s + n]), i) for i, (s, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))], "i8")
                one = first == np.arange(len(first))
                row, doc_id = rows[a:b][doc], ids[a:b][doc]
                out = [(-1 - int(rows[a]), squeezed(row[~one], (place - o2)[~one], (place - o1 + length)[~one]))] if not one.all() else []
                use = np.flatnonzero(one & ~is_hot)
                bucket = (mixed(head[use].view("u8")) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
                by = np.argsort(bucket, kind="stable")
                use, bucket = use[by], bucket[by]
                for i, j in runs(bucket):
                    some = use[i:j]
                    out.append((int(bucket[i]), squeezed(head[some], doc_id[some], row[some], at[some], data[spread(start[some], size[some])])))
                some = np.flatnonzero(is_hot & one)
                n = (o2 - o1 + 1)[some]
                of, p = np.repeat(some, n), spread(start[some], n)
                digests = pa.array([xxhash.xxh3_128_digest(view[s : s + length]) for s in p.tolist()], pa.binary())
                rest = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())]
                windows = [digests, pa.array(doc_id[of]), pa.array(row[of]), pa.array(p - offsets[doc[of]])]
                names = ["bucket", "blob", "w", "doc_id", "row", "start"]
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([x, pa.nulls(len(p), x.type)]) for x in rest), *(pa.concat_arrays([pa.nulls(len(out), x.type), x]) for x in windows)], names)

    return texts.mapInArrow(run, "bucket long, blob binary, w binary, doc_id long, row long, start long")


def prefixes(words: np.ndarray) -> np.ndarray:
    """How many first bytes each row of a sorted matrix of bytes shares with the one before; 0 for the first."""
    same = words[1:] == words[:-1]
    full = same.all(1)
    return np.concatenate([[0], np.where(full, words.shape[1], same.argmin(1))]).astype("i4")


def sorted_rows(matrix: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of rows of bytes (a multiple of eight of them), after the given keys."""
    words = matrix.view(">u8").astype("u8")
    return np.lexsort((*words.T[::-1], *first[::-1]))


def repeated_windows(head: np.ndarray, o2: np.ndarray, o1: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For contexts in the order of their documents, no two of them equal: a matrix (contexts, windows by distance from the
    anchor) of the windows that an earlier context has too.

    Contexts of a head are sorted by the text from the anchor on, and by the text before it, read backwards. A window that
    starts o before the anchor is its last o bytes there and its first length - o here; runs of rows with such common
    prefixes in both orders name it exactly."""
    n, width, behind = len(head), -(-length // 8) * 8, -(-(length - HEAD) // 8) * 8
    right, left = np.zeros((n, width), "u1"), np.zeros((n, behind), "u1")
    for at in range(0, n, 8192):
        part = slice(at, at + 8192)
        place, ahead, back = (starts + o2)[part, None], np.arange(width), np.arange(behind)
        right[part] = np.where(ahead < (length - o1)[part, None], data[np.minimum(place + ahead, len(data) - 1)], 0)
        left[part] = np.where(back < o2[part, None], data[np.maximum(place - 1 - back, 0)], 0)
    by_right, by_left = sorted_rows(right, head), sorted_rows(left, head)
    orders = []
    for order, matrix in ((by_right, right), (by_left, left)):
        common = prefixes(matrix[order])
        common[np.flatnonzero(head[order][1:] != head[order][:-1]) + 1] = -1
        most = np.empty(n, "i4")
        most[order] = np.maximum(common, np.append(common[1:], -1))
        orders.append((order, common, most))
    low, high = np.maximum(o1, length - orders[0][2]), np.minimum(o2, orders[1][2])
    found = np.zeros((n, length - HEAD + 1), bool)
    runs = np.empty((2, n), "i8")
    for o in range(length - HEAD + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        for k, need in enumerate((length - o, o)):
            order, common, _ = orders[k]
            runs[k][order] = np.cumsum(common < need) if need else np.cumsum(common < 0)
        name = runs[0][some] * (n + 1) + runs[1][some]
        _, first, of = np.unique(name, return_index=True, return_inverse=True)
        found[some, o] = first[of] != np.arange(len(some))
    return found


def settle(length: int) -> object:
    """A task's work on a bucket of candidates: the spans that go."""

    def run(table: pa.Table) -> pa.Table:
        spans = []
        if table.column("bucket")[0].as_py() < 0:
            spans = [opened(blob, "<i8", "<i8", "<i8") for blob in table.column("blob")]
        else:
            head, doc_id, row, at, data = joined([opened(blob, *CONTEXT) for blob in table.column("blob")], *CONTEXT)
            place, o2, o1 = windows_of(at)
            size = length + o2 - o1
            starts = np.cumsum(size) - size
            order = np.lexsort((at, row, doc_id))
            head, row, place, o2, o1, size, starts = (x[order] for x in (head, row, place, o2, o1, size, starts))
            view, text = memoryview(data), {}
            first = np.array([text.setdefault(bytes(view[s : s + n]), i) for i, (s, n) in enumerate(zip(starts.tolist(), size.tolist(), strict=True))], "i8")
            again = first != np.arange(len(first))
            spans.append([row[again], (place - o2)[again], (place - o1 + length)[again]])
            _, of, count = np.unique(head, return_inverse=True, return_counts=True)
            rest = np.flatnonzero(~again)
            count = np.bincount(of[rest], minlength=len(count))
            rest = rest[count[of[rest]] > 1]
            if len(rest):
                found = repeated_windows(head[rest], o2[rest], o1[rest], data, starts[rest], length)
                edge = np.diff(found.astype("i1"), axis=1, prepend=0, append=0)
                (i, near), (_, past) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # windows from past - 1 to near before the anchor
                spans.append([row[rest][i], place[rest][i] - past + 1, place[rest][i] - near + length])
        row, start, stop = joined(spans, "<i8", "<i8", "<i8")
        return pa.table([pa.array(row), pa.array(start), pa.array(stop)], names=["row", "start", "stop"])

    return run


def dense_spans(windows: DataFrame, length: int) -> DataFrame:
    """Spans of windows (w, doc_id, row, start), written, that stand earlier too: combined before the shuffle, so that a window that
    most documents have is no hot key."""
    firsts = windows.groupBy("w").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    named = counted_join(windows, written(firsts, "firsts"), "w", "n")
    later = F.struct("doc_id", "row", "start") != F.col("first")
    return named.filter(F.col("first").isNotNull() & later).select("row", "start", (F.col("start") + length).alias("stop"))


def spans_of(texts: DataFrame, candidates: DataFrame, length: int = LENGTH, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, start, stop): spans of bytes that go, several may overlap, from pointers (head, row, at) to texts (row, doc_id,
    z). A head of more than `hot` candidates is hot, or of more than a 100,000th of all."""
    candidates = written(candidates, "candidates")
    heads = candidates.groupBy("head").agg(F.count("*").alias("n"))
    n = candidates.count()
    hottest = np.array([r["head"] for r in heads.filter(F.col("n") > max(hot, n / BROADCAST_ROWS)).collect()], "i8")  # BROADCAST_ROWS at most
    wanted = candidates.groupBy("row").agg(F.collect_set(F.struct("head", "at")).alias("x"))
    around = texts.select("row", "doc_id", "z").join(wanted, "row")
    met = contexts(around, length, max(1, -(-n * 300 // bucket_bytes)), hottest)
    if len(hottest):
        met = written(met, "contexts")
    found = met.filter("bucket IS NOT NULL").select("bucket", "blob").groupBy("bucket").applyInArrow(settle(length), SPAN)
    return found.unionByName(dense_spans(met.filter("w IS NOT NULL").select("w", "doc_id", "row", "start"), length)) if len(hottest) else found


def without_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of texts and their spans; kept holds the bytes that stay,
    null where that is the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, n_spans, shas, kept = [], [], [], []
            for sha, z, x in zip(batch.column("sha"), batch.column("z"), batch.column("x"), strict=True):
                if not x.is_valid:
                    removed.append(0)
                    n_spans.append(0)
                    shas.append(sha.as_py())
                    kept.append(None)
                    continue
                start, stop = (x.values.field(c).to_numpy() for c in ("start", "stop"))
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                gap = np.concatenate([[True], start[1:] > stop[:-1]])
                begins, ends = start[gap], stop[np.append(gap[1:], True)]
                text = press.decompress(z.as_buffer())
                parts = [text[i:j] for i, j in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True)]
                kept.append(b"".join(parts))
                removed.append(int((ends - begins).sum()))
                n_spans.append(len(begins))
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    own = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("x"))
    return texts.join(own, "row", "left").select("doc_id", "n_bytes", "sha", "z", "x").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), see without_spans.

    Texts count as UTF-8 bytes, whole, however long; a null text is empty. Earlier is a smaller doc_id (null ids first),
    of rows that repeat an id the one read first, and in a document the earlier start. A text shorter than `length` stays.
    Other columns aren't read. An empty table gives an empty result. length is 255 at most, and greater than HEAD.
    """
    bounded_batches(docs.sparkSession)
    texts = stored(docs, id_col, text_col, batches)
    total = texts.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    levels, found = Levels(max(1, -(-total // bucket_bytes)), length), None
    numbers = range(batches)
    for b in numbers:
        part = pointers(levels.add(texts.filter(F.col("batch") == b).select("row", "z"), keep=b < batches - 1))
        found = part if found is None else found.unionByName(part)
    return without_spans(texts, spans_of(texts, found, length, hot, bucket_bytes))
