"""SimHash near-duplicates by the Jaccard similarity of word shingles, verified exactly.

At a similarity of 0.8 about 15 % of the bits of two fingerprints differ, so that 64 bits can't tell such pairs from
others. Fingerprints here have WORDS words of 64 bits, and the generalised pigeonhole of simhash deals each word's bits to
correlated groups. A dynamic programme allocates the thresholds over all groups, by the candidates that the corpus gives:
the cheapest allocation by which a pair of similarity 0.8 shares no key with a chance of MISSED at most; more similar
pairs are missed less. Fingerprints that share a key are compared by their first four words and linked if those differ in
few bits. The sets of a component of such links then meet whole and are compared exactly, by a prefix filter that loses
no pair. A large component is cut into blocks: first all its blocks meet one of them; only sets that this leaves outside
the largest class so found meet all blocks, so that the work grows with the component, and with those sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_shuffle, carried, counted_join, lookup_join, sized, written
from .simhash import BITS, bit_groups, bit_statistics, components, equal_pairs, keys_of, labelled_classes, met, probes, spanning

WIDTH = 5
#: Sets are near copies if their similarity is NUMERATOR / DENOMINATOR at least.
NUMERATOR, DENOMINATOR = 4, 5
#: Words of a fingerprint, and how many of them are compared where fingerprints meet.
WORDS, COMPARED = 32, 4
#: The chance that a bit differs between sets of equal size at that similarity, and the planned chance to miss a pair.
DIFFERS = math.acos(2 * NUMERATOR / (NUMERATOR + DENOMINATOR)) / math.pi
MISSED = 0.002
#: Bits of the compared words that may differ: the mean at that similarity and four standard deviations.
FAR = math.floor(BITS * COMPARED * DIFFERS + 4 * math.sqrt(BITS * COMPARED * DIFFERS * (1 - DIFFERS)))
#: Sets and shingles of one block, about; two blocks meet in a task.
BLOCK_SETS, BLOCK_ITEMS = 1000, 1_000_000
#: Odd multipliers: of a word's place in a shingle, and of each word of a fingerprint.
_PLACE = np.array([xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(WIDTH)], "u8")
_TIMES = np.array([xxhash.xxh64_intdigest(b"times %d" % i) | 1 for i in range(WORDS)], "u8")
_FINGERPRINT = [f"f{i}" for i in range(WORDS)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingled(texts: pa.Array) -> list[np.ndarray]:
    """The set of 64-bit hashes of word shingles of each text, sorted. Words as for the fingerprints of simhash: A-Z
    lower-cased, split at ASCII white space; fewer than WIDTH of them are one shingle, none are none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.utf8_trim(pc.fill_null(texts, ""), " \t\n\v\f\r")))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(w) for w in names], "u8")[coded.indices.to_numpy()] if names else np.zeros(0, "u8")
    blank = names.index("") if "" in names else -1
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    n = len(values) - WIDTH + 1
    wide = mixed(sum(values[k : k + n] * _PLACE[k] for k in range(WIDTH))) if n > 0 else np.zeros(0, "u8")
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(wide[a : b - WIDTH + 1]))
        elif b == a or (b == a + 1 and coded.indices[a].as_py() == blank):
            out.append(np.zeros(0, "u8"))
        else:
            out.append(mixed((values[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype="u8") + np.uint64(b - a)))
    return out


def name_of(items: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(items.tobytes())], "u8").view("i8")[0]) if len(items) else 0


def majority(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x: (rows, sets, words) of bits, zeros below a set's own rows; counts: rows of each set. The bits set in over half
    of a set's rows, as (sets, words). Rows are added by carry-save adders, 64 counters at once."""
    planes, level = [], x
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3
            if third:
                a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
                one = a ^ b
                carries.append(a & b | c & one)
                level = np.concatenate([one ^ c, level[3 * third :]])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    least = counts // 2 + 1
    more = np.zeros(x.shape[1:], "u8")
    same = ~more
    for k in reversed(range(max(len(planes), int(least.max(initial=0)).bit_length()))):
        plane = planes[k] if k < len(planes) else np.zeros_like(more)
        wanted = (-(least >> k & 1)).astype("i8").view("u8")[:, None]
        more |= same & plane & ~wanted
        same &= ~(plane ^ wanted)
    return more | same


def fingerprints(sets: list[np.ndarray], room: int = 1 << 18, longest: int = 1 << 14) -> np.ndarray:
    """(sets, WORDS): the SimHash words of each set; zeros for the empty one. Sets of about one size are taken together."""
    out = np.zeros((len(sets), WORDS), "u8")
    sizes = np.array([len(x) for x in sets], "i8")
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        if n > longest:  # counted in parts
            k = order[at]
            total = np.zeros(WORDS * BITS, "i8")
            for start in range(0, n, longest):
                x = hashed(sets[k][start : start + longest])
                total += np.unpackbits(x.astype(">u8").view("u1").reshape(len(x), -1), axis=1).sum(0, dtype="i8")
            out[k] = np.packbits(2 * total > n).view(">u8")
            at += 1
            continue
        end = at + 1
        while end < len(order) and (top := int(sizes[order[end]])) <= longest and top * (end + 1 - at) * WORDS <= room and 8 * top <= 9 * n + 8:
            end += 1
        these = order[at:end]
        x = np.zeros((int(sizes[these[-1]]), len(these), WORDS), "u8")
        for i, k in enumerate(these):
            x[: sizes[k], i] = hashed(sets[k])
        out[these] = majority(x, sizes[these])
        at = end
    return out


def hashed(items: np.ndarray) -> np.ndarray:
    x = items[:, None] * _TIMES
    return x ^ x >> np.uint64(32)


def marks(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The carried columns, the name fp of each row's set, and the words f0, f1, ... of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        for batch in (s for b in batches for s in sized(b, "x0")):
            sets = shingled(batch.column("x0"))
            found = fingerprints(sets).view("i8")
            yield batch.num_rows, [pa.array([name_of(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(WORDS))]

    return carried(docs, [F.col("text")], carry, ", ".join(f"{c} long" for c in ["fp", *_FINGERPRINT]), run)


def planned(distinct: DataFrame, choices: tuple[int, ...] = (2, 3, 4, 5), most: int = 2, probe_cost: float = 100.0) -> list[tuple[str, list[int], int]]:
    """The groups of bits (word, bits) with the thresholds that cost least: keys to probe and candidates to compare.

    For each number of groups in a word a dynamic programme over all groups picks thresholds (none, or 0 to most) whose
    chances to miss a pair of similarity 0.8 multiply to MISSED at most, or come as near as they can. A
    shuffled row costs about as much as probe_cost comparisons. Groups and
    candidates are those of the first word, over all sets; the bits of the others are alike, as one hash gives them all.
    """
    n, ones, both = bit_statistics(distinct, "f0")
    groupings = {m: bit_groups(n, ones, both, m) for m in choices}
    equal = equal_pairs(distinct, groupings, "f0")
    steps = 400
    unit = -math.log(MISSED) / steps
    best: tuple[float, float, list[tuple[str, list[int], int]]] | None = None
    for m, groups in groupings.items():
        options = []
        for i, bits in enumerate(groups):
            pairs, found = max(equal.get((m, i), 0.0), 1.0), [(0, 0.0, -1)]
            for t in range(most + 1):
                missed = 1 - sum(math.comb(len(bits), k) * DIFFERS**k * (1 - DIFFERS) ** (len(bits) - k) for k in range(t + 1))
                found.append((int(-math.log(missed) / unit), probes(len(bits), t) * (probe_cost * n + pairs * 2**t), t))
            options.append((bits, found))
        costs, picked = np.full(steps + 1, np.inf), []
        costs[0] = 0.0
        for word in range(WORDS):
            for bits, found in options:
                new, choice = np.full(steps + 1, np.inf), np.zeros((steps + 1, 2), "i8")
                for gain, cost, t in found:
                    for had in np.flatnonzero(costs < np.inf).tolist():
                        to = min(had + gain, steps)
                        if costs[had] + cost < new[to]:
                            new[to], choice[to] = costs[had] + cost, (had, t)
                costs = new
                picked.append((word, bits, choice))
        reached = int(np.flatnonzero(costs < np.inf).max())
        allocated, state = [], reached
        for word, bits, choice in reversed(picked):
            state, t = choice[state].tolist()
            if t >= 0:
                allocated.append((f"f{word}", bits, t))
        if best is None or (-reached, costs[reached]) < best[:2]:
            best = (-reached, costs[reached], allocated[::-1])
    return best[2]


def near_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links (as indexes) among sets of similarity 0.8 or more, none of which is missed.

    Two such sets share one of the rarest n - ceil(0.8 n) + 1 items of each, n being its size. Pairs that are connected
    already aren't compared. Groups of sets are kept as the bits of whole numbers."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = [len(sets[k]) for k in order]
    _, ids, counts = np.unique(np.concatenate([sets[k] for k in order] or [np.zeros(0, "u8")]), return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("i8")
    with_item: dict[int, int] = {}
    group = list(range(len(order)))  # a set's group, followed to its root
    members = [1 << x for x in range(len(order))]
    found = []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    low = 0
    for x, n in enumerate(sizes):
        while DENOMINATOR * sizes[low] < NUMERATOR * n:
            low += 1
        own = ids[starts[x] : starts[x + 1]]
        prefix = own[np.lexsort((own, counts[own]))][: n + NUMERATOR * n // -DENOMINATOR + 1] if n else own
        near = 0
        for item in prefix[counts[prefix] > 1].tolist():
            had = with_item.get(item, 0)
            near |= had
            with_item[item] = had | 1 << x
        near = near >> low << low  # those before are too small
        while near:
            y = (near & -near).bit_length() - 1
            shared = len(np.intersect1d(own, ids[starts[y] : starts[y + 1]], assume_unique=True))
            if (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (n + sizes[y]):
                a, b = sorted((root(x), root(y)))
                group[b] = a
                members[a] |= members[b]
                found.append((order[y], order[x]))
                near &= ~members[a]
            else:
                near &= near - 1
    return found


def verified(dealt: DataFrame) -> DataFrame:
    """(a, b): links that connect near copies among the sets (fp, items) of each (label, i, j)."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition's rows come sorted by group; a group may span batches.
        at, names, sets = None, [], []

        def solved() -> pd.DataFrame:
            pairs = np.array(near_links(sets), "i8").reshape(-1, 2)
            found = spanning(np.array(names, "i8"), iter([(pairs[:, 0], pairs[:, 1])]))
            return pd.DataFrame(np.array(found, "i8").reshape(-1, 2), columns=["a", "b"])

        for frame in batches:
            for label, i, j, fp, items in frame.itertuples(index=False):
                if (label, i, j) != at:
                    if len(sets) > 1:
                        yield solved()
                    at, names, sets = (label, i, j), [], []
                names.append(fp)
                sets.append(np.frombuffer(items, "u8"))
        if len(sets) > 1:
            yield solved()

    dealt = dealt.select("label", "i", "j", "fp", "items").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return dealt.mapInPandas(verify, "a long, b long").filter("a <> b").distinct()


def every(n: Column | str, start: int = 0) -> Column:
    return F.explode(F.sequence(F.lit(start), F.col(n) - 1 if isinstance(n, str) else n - 1))


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links among names of sets that connect all near copies. distinct: (fp, h, f0, ...), h of a row of docs with
    that set; docs: (h, text)."""
    sets = distinct.filter("fp <> 0")
    words = _FINGERPRINT[:COMPARED]
    meet = written(met(keys_of(sets, planned(sets), ["fp", *words]), "fp", words, FAR), "meet")
    candidates = written(components(meet), "candidates")
    n = candidates.count()
    named = lookup_join(distinct.select(F.col("fp").alias("node"), "h"), candidates, "node", n, "inner", 1)
    texts = lookup_join(docs.select("h", "text"), written(named.select("h", "label"), "picked"), "h", n, "inner").dropDuplicates(["h"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        for batch in (s for b in batches for s in sized(b, "x0")):
            found = shingled(batch.column("x0"))
            yield batch.num_rows, [pa.array([name_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]

    bounded_batches(docs.sparkSession)
    sets = written(carried(texts, [F.col("text")], ["label"], "fp long, n long, items binary", pack), "sets")
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ITEMS), F.lit(1)).cast("int")
    per_label = written(sets.groupBy("label").agg(n_blocks.alias("n_blocks"), F.count("*").alias("n_rows")), "labels")
    own = F.pmod(F.xxhash64("fp"), "n_blocks").cast("int").alias("own")
    blocks = counted_join(sets, per_label, "label", "n_rows").select("label", "fp", "items", "n_blocks", own)
    # A component of one block meets itself; the blocks of a larger one meet its block 0.
    others = blocks.filter("own > 0").select("label", F.lit(0).alias("i"), F.col("own").alias("j"), "fp", "items")
    first = blocks.filter("own = 0").select("label", F.lit(0).alias("i"), "n_blocks", "fp", "items")
    alone = first.filter("n_blocks = 1").withColumn("j", F.lit(0))
    spread = first.filter("n_blocks > 1").select("label", "i", every("n_blocks", 1).alias("j"), "fp", "items")
    known = written(verified(others.unionByName(alone.drop("n_blocks")).unionByName(spread)), "known")
    large = per_label.filter("n_blocks > 1")
    if large.isEmpty():
        return known
    # Of a larger component: the sets outside its largest class, which meet all blocks.
    names = blocks.filter("n_blocks > 1").select("label", "fp")
    classes = written(components(known).select(F.col("node").alias("fp"), F.col("label").alias("class")), "classes")
    member = written(lookup_join(names, classes, "fp", classes.count(), salts=1).select("label", "fp", F.coalesce("class", "fp").alias("class")), "member")
    sizes = member.groupBy("label", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("label").agg(F.max_by("class", F.struct("n", "class")).alias("class"), F.max("n").alias("n_class"), F.sum("n").alias("n_label"))
    largest = written(largest.filter("n_class < n_label").select("label", "class", F.ceil((F.col("n_label") - F.col("n_class")) / BLOCK_SETS).cast("int").alias("n_rest"), "n_label"), "largest")
    if largest.isEmpty():
        return known
    outside = counted_join(member, largest.withColumnRenamed("class", "most"), "label", "n_label").filter("n_rest IS NOT NULL AND class <> most").select("fp", F.lit(True).alias("outside"))
    outside = written(outside, "outside")
    again = counted_join(blocks.filter("n_blocks > 1"), largest.select("label", "n_rest", "n_label"), "label", "n_label").filter("n_rest IS NOT NULL").drop("n_label")
    again = lookup_join(again, outside, "fp", outside.count(), salts=1)
    theirs = again.select("label", every("n_rest").alias("i"), F.col("own").alias("j"), "fp", "items")
    rest = again.filter("outside").select("label", F.pmod(F.xxhash64("fp", F.lit(1)), "n_rest").cast("int").alias("i"), every("n_blocks").alias("j"), "fp", "items")
    return known.unionByName(verified(theirs.unionByName(rest))).distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, h), distinct: the rows of docs (doc_id, h, text) that are not the first of their component of near copies.
    h is a hash of the text. The first has the least doc_id, null ids last; rows of its set and id stay."""
    marked = written(marks(docs, ["doc_id", "h"]), "marked")
    words = [F.first(c).alias(c) for c in _FINGERPRINT]  # rows of one set have one fingerprint
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("h").alias("h"), F.count("*").alias("n_rows"), *words), "distinct")
    found = labelled_classes(distinct.select("fp", "first_id"), links(docs, distinct)).join(by_shuffle(distinct.select("fp", "n_rows")), "fp")
    shared = written(found.filter("n_rows > 1 OR fp <> component_fp"), "shared")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("component_fp"))
    rows = counted_join(marked.select("fp", "doc_id", "h"), shared, "fp", "n_rows").filter("component_fp IS NOT NULL")
    return written(rows.filter(~stays).select("doc_id", "h").distinct(), "gone")
