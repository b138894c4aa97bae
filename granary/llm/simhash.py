"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints are split into m groups of correlated bits with thresholds t_1 ... t_m that add up to
distance - m + 1: of two fingerprints within the distance, at least one group differs in at most t_i bits (-1: a group that isn't
probed). A dynamic programme picks the thresholds, and then m, by what they cost on the whole corpus: keys to probe
and candidates to verify, the latter from counts of equal group values. Fingerprints that share a key meet and are
verified; a key that many share is dealt to tasks in pairs of blocks. Tasks return spanning links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, carried, counted_join, lookup_join, sized, written

BITS = 64
#: Rows of one block; two blocks meet in a task.
BLOCK = 2000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash over XXH64 of word shingles, repeats included; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    counts = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, fp), a row per row of docs; fp holds the fingerprint's bits as a signed long. With carry, those columns
    stand instead of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        for batch in batches:
            for part in sized(batch, "x0"):
                yield part.num_rows, [pa.array(np.array([fingerprint(x.as_py(), width) for x in part.column("x0")], "u8").view("i8"))]

    if carry is None:
        docs, carry, text_col = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text"
    return carried(docs, [F.col(text_col)], carry, "fp long", run)


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray, np.ndarray]:
    """Over all fingerprints: their number, how often each bit is set, how often each two are. 64 * 64 rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(column).to_numpy(zero_copy_only=False).astype(">i8")
            for at in range(0, len(values), 50_000):
                bits = np.unpackbits(values[at : at + 50_000].view("u1").reshape(-1, 8), axis=1).astype("f4")
                both += bits.T @ bits
            n += len(values)
        columns = [pa.array(np.repeat(np.arange(BITS), BITS)), pa.array(np.tile(np.arange(BITS), BITS)), pa.array(both.ravel()), pa.array(np.where(np.arange(BITS * BITS) == 0, n, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "both", "n"])

    rows = fps.select(column).mapInArrow(run, "a long, b long, both double, n long").groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    both[rows["a"], rows["b"]] = rows["both"]
    return int(rows["n"].sum()), both.diagonal().copy(), both


def bit_groups(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal width (to one bit): each grows from the free bit that is most correlated with the others left."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: tied[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: tied[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def packed(column: str, bits: list[int], without: int | None = None) -> F.Column:
    """The named bits (0 is the highest) of a long column as a smaller number; `without` counts as 0."""
    mask = sum(1 << (BITS - 1 - b) for b in bits if b != without)
    return F.col(column).bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask))


def equal_pairs(fps: DataFrame, groupings: dict[int, list[list[int]]], column: str = "fp") -> dict[tuple[int, int], float]:
    """For each group of each grouping: pairs of fingerprints that agree on it, counted over all of them."""
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), packed(column, bits).alias("key")) for m, groups in groupings.items() for i, bits in enumerate(groups)]
    counts = fps.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.m", "x.i", "x.key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.groupBy("m", "i").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).collect()  # a row per group
    return {(r["m"], r["i"]): r["pairs"] for r in rows}


def probes(width: int, threshold: int) -> int:
    """Keys of a group of that width: each way to leave out `threshold` of its bits."""
    return math.comb(width, threshold) if threshold >= 0 else 0


def thresholds(groups: list[list[int]], equal: list[float], n: int, ones: np.ndarray, distance: int, probe_cost: float = 2.0) -> tuple[float, list[int]]:
    """The cheapest thresholds with the sum distance - m + 1, by dynamic programming over groups and sums.

    A group's candidates within t bits are its pairs of equal values times the ratio of the chances to differ in at
    most t bits and in none, from the corpus-wide chance of each bit to differ.
    """
    q = 2 * (ones / max(n, 1)) * (1 - ones / max(n, 1))
    least, total = -1, distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, pairs in zip(groups, equal, strict=True):
        chance = np.array([1.0])
        for b in bits:
            chance = np.convolve(chance, [1 - q[b], q[b]])
        ratio = np.cumsum(chance) / max(chance[0], 1e-30)
        after: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, picked) in best.items():
            for t in range(least, distance + 1):
                more = 0.0 if t < 0 else probe_cost * n * probes(len(bits), t) + max(pairs, 1.0) * ratio[min(t, len(bits))] * probes(len(bits), t) / max(t, 1)
                if had + t not in after or cost + more < after[had + t][0]:
                    after[had + t] = (cost + more, [*picked, t])
        best = after
    return best[total]


def plan(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """The groups of bits and their thresholds: the cheapest of the given numbers of groups."""
    n, ones, both = bit_statistics(fps)
    groupings = {m: bit_groups(n, ones, both, m) for m in choices if m <= distance + 1}
    equal = equal_pairs(fps, groupings)
    cost, picked, m = min((*thresholds(g, [equal.get((m, i), 0.0) for i in range(m)], n, ones, distance), m) for m, g in groupings.items())
    return list(zip(groupings[m], picked, strict=True))


def keys_of(fps: DataFrame, planned: list[tuple[str, list[int], int]], carry: Sequence[str]) -> DataFrame:
    """(part, key) and the carried columns: two fingerprints that differ in at most t bits of a planned (word, bits, t)
    share a row's (part, key).

    A group of threshold t gives a key for each choice of t of its bits that it leaves out; part names group and choice.
    """
    from itertools import combinations

    structs, part = [], 0
    for word, bits, t in planned:
        for left_out in combinations(bits, t) if t >= 0 else ():
            structs.append(F.struct(F.lit(part).alias("part"), packed(word, [b for b in bits if b not in left_out]).alias("key")))
            part += 1
    return fps.select(*carry, F.explode(F.array(*structs)).alias("x")).select("x.part", "x.key", *carry)


def spanning(names: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that connect the names which pairs of indexes connect: from the least name of each group to its others, so
    that several tasks tend to give the same links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for left, right in pairs:
        for a, b in zip(names[left].tolist(), names[right].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in list(parent)]


def near_pairs(words: list[np.ndarray], cuts: np.ndarray, within: np.ndarray, side: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows within the distance, group by group (from cuts[k] to cuts[k + 1]). A group that isn't `within`
    is two blocks, and only pairs across the sides are taken."""
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    few = np.diff(cuts) <= 64

    def far(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[a] ^ w[b]).astype("i4") for w in words)

    at = np.flatnonzero(few[group] & within[group])
    for lag in range(1, 64):  # rows of small groups against the row so many places on
        at = at[at + lag < len(group)]
        at = at[group[at + lag] == group[at]]
        if not len(at):
            break
        near = at[far(at, at + lag) <= distance]
        yield near, near + lag
    for k in np.flatnonzero(~(few & within)).tolist():
        rows = np.arange(cuts[k], cuts[k + 1])
        if within[k]:
            for i in range(len(rows) - 1):
                near = rows[i + 1 :][far(rows[i], rows[i + 1 :]) <= distance]
                yield np.full(len(near), rows[i]), near
        else:
            left, right = rows[~side[rows]], rows[side[rows]]
            for i in left.tolist():
                near = right[far(i, right) <= distance]
                yield np.full(len(near), i), near


def met(keyed: DataFrame, name: str, words: Sequence[str], distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all names that share a (part, key) and whose words differ in at most distance bits.

    A key that more than block rows share is dealt to tasks in pairs of blocks; such keys are counted first, combined
    before the shuffle. Links of a task connect, they aren't all its pairs."""
    hot = written(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "hot")
    cut = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64(name), cut).cast("int")
    # Block i meets every block j: the pair's lower number first. Most keys have one block, hence the pair (0, 0).
    sized_keys = counted_join(keyed, hot, ["part", "key"], "n")
    named = list(dict.fromkeys([name, *words]))
    dealt = sized_keys.select("part", "key", *named, own.alias("own"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
    dealt = dealt.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *named)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition's rows come sorted by group; a group may span batches, and is verified once it is whole.
        held: list[pd.DataFrame] = []

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            group = frame[["part", "key", "i", "j"]].to_numpy("i8")
            cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(frame)]])
            first = cuts[:-1]
            side = frame["own"].to_numpy() == group[:, 3]
            values = [frame[w].to_numpy("i8").view("u8") for w in words]
            found = spanning(frame[name].to_numpy("i8"), near_pairs(values, cuts, group[first, 2] == group[first, 3], side, distance))
            return pd.DataFrame(np.array(found, "i8").reshape(-1, 2), columns=["a", "b"])

        for frame in batches:
            held.append(frame)
            if sum(map(len, held)) < 20_000:
                continue
            frame = pd.concat(held, ignore_index=True)
            names = frame[["part", "key", "i", "j"]].to_numpy("i8")
            whole = np.flatnonzero((names != names[-1]).any(1))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield solve(frame.iloc[:cut])
            held = [frame.iloc[cut:]]
        if held and sum(map(len, held)):
            yield solve(pd.concat(held, ignore_index=True))

    dealt = dealt.repartition(F.col("part"), F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("part", "key", "i", "j")
    return dealt.mapInPandas(verify, "a long, b long").distinct()


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect all those within the distance of each other."""
    planned = [("fp", bits, t) for bits, t in plan(fps, distance, choices)]
    return met(keys_of(fps, planned, ["fp"]), "fp", ["fp"], distance, block)


def roots(hooks: DataFrame) -> DataFrame:
    """(was, now): where each node's hooks end, of a written (node, to) in which every `to` is a node and roots hook to
    themselves. Each round follows what is known two times more, so that a chain is three times shorter after it."""
    while True:
        n = hooks.count()
        up = hooks.select(F.col("node").alias("to"), F.col("to").alias("top"))
        once = lookup_join(hooks, up, "to", n, "inner", 16).select("node", F.col("to").alias("first"), F.col("top").alias("to"))
        twice = lookup_join(once, up, "to", n, "inner", 16)
        hooks = written(twice.select("node", F.col("top").alias("to"), (F.col("top") != F.col("first")).alias("moved")), "hooks")
        if hooks.filter("moved").isEmpty():
            return hooks.select(F.col("node").alias("was"), F.col("to").alias("now"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge (a, b), in any direction: the least node reachable.

    In each round every label hooks to the least label beside it, and hooks are followed to their ends; nodes take these
    as labels, and so do the ends of edges. Edges within a label go and equal ones become one. Each tree of hooks holds two
    labels at least, so that rounds, and the steps to follow a round's hooks, are about the logarithm of the nodes, for
    long chains as well. Each step is written to the shared folder, and only counts come to the driver. A node of many
    edges, or a label of many nodes, is no hot key: the rows of a round's labels are broadcast while they are few, else
    joined by salted keys.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        hooks = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        n = hooks.count()
        ended = roots(hooks)
        if labels is None:
            labels = ended.select(F.col("was").alias("node"), F.col("now").alias("label"))
        else:
            moved = lookup_join(labels.withColumnRenamed("label", "was"), ended, "was", n, "left", 16)
            labels = written(moved.select("node", F.coalesce("now", "was").alias("label")), "labels")
        ends = lookup_join(left.select(F.col("a").alias("was"), "b"), ended, "was", n, "inner", 16).select(F.col("now").alias("a"), F.col("b").alias("was"))
        ends = lookup_join(ends, ended, "was", n, "inner", 16).select("a", F.col("now").alias("b"))
        left = written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def labelled_classes(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component_id, component_fp) of distinct rows (fp, first_id) and links (a, b) among their fp; see classes()."""
    labelled = written(components(linked).select(F.col("node").alias("fp"), "label"), "components")
    member = written(distinct.join(by_shuffle(labelled), "fp", "left"), "member")
    # Of the members the one with the least id; null ids come last.
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp"))
    least = written(member.filter("label IS NOT NULL").groupBy("label").agg(first.alias("x"), F.count("*").alias("n_rows")).select("label", F.col("x.first_id").alias("component_id"), F.col("x.fp").alias("component_fp"), "n_rows"), "least")
    named = counted_join(member.filter("label IS NOT NULL"), least, "label", "n_rows").select("fp", "component_id", "component_fp")
    return member.filter("label IS NULL").select("fp", F.col("first_id").alias("component_id"), F.col("fp").alias("component_fp")).unionByName(named)


def classes(fps: DataFrame, distance: int = 4, block: int = BLOCK, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(fp, n_rows, component_id, component_fp) of rows (doc_id, fp), a row per distinct fp: how many rows have it, the
    least doc_id of the component and the least fingerprint that it has there."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "distinct")
    found = labelled_classes(distinct, links(distinct.select("fp"), distance, block, choices))
    return distinct.select("fp", "n_rows").join(by_shuffle(found), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = 4, block: int = BLOCK, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    Words are split at ASCII white space, A-Z lower-cased; documents are linked when fingerprints differ in at most
    `distance` bits; component_id is the smallest doc_id reachable. Equal fingerprints are taken once. A null text has no
    words, hence fingerprint 0 like the empty one. A null id takes part; a component of null ids alone has a null
    component_id. Repeated rows give repeated rows. Whole texts count, however long; other columns aren't read, whatever their
    names. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    found = classes(fps, distance, block, choices)
    # A fingerprint of one row that nothing is linked to needs no join.
    shared = written(found.filter("n_rows > 1 OR fp <> component_fp"), "shared")
    named = counted_join(fps, shared, "fp", "n_rows")
    alone = F.col("component_fp").isNull()
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
