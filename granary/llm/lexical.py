"""Ranked lexical search over an index whose strata are documents of one normaliser.

A document's normaliser m depends on its length alone, so documents of equal m form a stratum, and the impact of a
term there depends on its tf only. A stratum is cut into chunks; a chunk holds its distinct terms with their greatest tf,
and their postings ordered by term and tf, so that an impact is computed once for all documents with that tf. The sum of
a query's impacts at the greatest tf bounds what a chunk can give. A first round visits each query's chunks of greatest
bound and gives the score that its k-th document reaches at least; the second visits every other chunk whose bound
reaches that. Scores are whole numbers and exact; no document that could be among the first k is passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, sized, written

#: Postings of a chunk, about. Queries of one block, about, and their terms.
CHUNK, BLOCK_QUERIES = 400_000, 512
#: Chunks that the first round visits for each query.
FIRST = 2
#: Fixed values of the score.
SCALE, SLOPE, BASE, SHARE = 1_000_000_000, 8, 10, 90
#: Bytes to bytes: A to Z lower-cased, what isn't in a term as a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "m long, chunk long, n_docs int, doc_ids binary, terms array<string>, max_tf binary, df binary, counts binary, tfs binary, docs binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text with repeats: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): terms joined by blanks, in order, and their counts as 32-bit integers. Only documents
    with a term; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sized(b, "text", 16 << 20)):
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if found:
                    counts = Counter(found)
                    names = sorted(counts)
                    ids.append(i)
                    sizes.append(len(found))
                    terms.append(b" ".join(names))
                    tfs.append(np.fromiter(map(counts.__getitem__, names), "<i4", len(names)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary"), "counted")


@dataclass(frozen=True)
class Index:
    """chunks: the written table of chunks. n_docs documents with a term, n_terms terms in them with repeats."""

    chunks: DataFrame
    n_docs: int
    n_terms: int


def chunked(table: pa.Table) -> pa.Table:
    """One chunk's rows (m, chunk, doc_id, terms, tfs) as a row of the index."""
    order = pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_start")
    table = table.take(order)
    lists = pc.split_pattern(pc.cast(table.column("terms").combine_chunks(), pa.string()), " ")
    coded = lists.values.dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy()
    tf = np.frombuffer(b"".join(table.column("tfs").to_pylist()), "<i4")
    doc = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
    ranked = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(ranked), "i4")
    place[ranked] = np.arange(len(ranked), dtype="i4")
    term = place[coded.indices.to_numpy()]
    by = np.lexsort((doc, tf, term))
    term, tf, doc = term[by], tf[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))  # of each (term, tf)
    df = np.bincount(term, minlength=len(ranked)).astype("i4")
    ends = np.cumsum(df) - 1
    ids = table.column("doc_id").combine_chunks()
    nulls = ids.null_count  # they come first
    packed = np.concatenate([[nulls], ids.drop_null().to_numpy()]).astype("i8")
    row = {
        "m": table.column("m")[0].as_py(), "chunk": table.column("chunk")[0].as_py(), "n_docs": len(sizes), "doc_ids": packed.tobytes(),
        "terms": coded.dictionary.take(pa.array(ranked)).to_pylist(), "max_tf": tf[ends].tobytes(), "df": df.tobytes(),
        "counts": np.diff(np.append(first, len(tf))).astype("i4").tobytes(), "tfs": tf[first].tobytes(), "docs": doc.tobytes(),
    }
    kinds = [("m", pa.int64()), ("chunk", pa.int64()), ("n_docs", pa.int32()), ("doc_ids", pa.binary()), ("terms", pa.list_(pa.string())), *((c, pa.binary()) for c in ("max_tf", "df", "counts", "tfs", "docs"))]
    return pa.Table.from_pylist([row], pa.schema(kinds))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> Index:
    """Index every document that has a term, with all its terms.

    Whole texts count, however long; a null text has no term. Rows that repeat an id are documents of their own. A stratum
    of many documents is cut into chunks of about `chunk` postings, by a hash of the row, so that no length is a hot key;
    a document of more terms than that is a chunk for itself or shares one. Other columns aren't read.
    """
    counted = counted_terms(docs, id_col, text_col)
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    m = F.expr(f"{BASE}L + ({SHARE}L * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = counted.select(m.alias("m"), "doc_id", "terms", "tfs", F.monotonically_increasing_id().alias("row"))
    strata = rows.groupBy("m").agg(F.ceil(F.sum(F.length("tfs") / 4) / chunk).cast("long").alias("parts"))
    many = written(strata.filter("parts > 1"), "strata")  # the others are one chunk each
    side = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    dealt = rows.join(side, "m", "left").select("m", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).alias("chunk"), "doc_id", "terms", "tfs")
    return Index(written(dealt.groupBy("m", "chunk").applyInArrow(chunked, INDEX), "index"), n_docs, n_terms)


def impacts(weights: np.ndarray | int, tf: np.ndarray, m: int) -> np.ndarray:
    return weights * (SCALE * tf.astype("i8") // (1000 * tf.astype("i8") + SLOPE * m))


@dataclass(frozen=True)
class Block:
    """A block of queries: its distinct terms with their weights, and of each query the places of its terms."""

    terms: list[str]
    weights: np.ndarray
    queries: list[np.ndarray]

    def places(self, own: pa.Array) -> np.ndarray:
        """Where a chunk's terms have each of the block's, -1 for none."""
        return pc.fill_null(pc.index_in(pa.array(self.terms, pa.string()), own), -1).to_numpy()

    def bounds(self, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the terms in a chunk, and for each query what a document there scores at most."""
        at = self.places(batch.column("terms")[row].values)
        most = np.frombuffer(batch.column("max_tf")[row].as_buffer(), "<i4")
        best = np.where(at >= 0, impacts(self.weights, most[at], batch.column("m")[row].as_py()), 0)
        return at, np.array([best[q].sum() for q in self.queries], "i8")


def frequencies(chunks: DataFrame, terms: list[str]) -> dict[str, int]:
    """How many documents hold each of the terms, over all chunks; a number per term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), "i8")
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.fill_null(pc.index_in(pa.array(terms, pa.string()), batch.column("terms")[row].values), -1).to_numpy()
                df = np.frombuffer(batch.column("df")[row].as_buffer(), "<i4")
                total += np.where(at >= 0, df[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = chunks.select("terms", "df").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {terms[r["k"]]: r["n"] for r in rows}


class Best:
    """The k best documents of each query so far, in a task."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.named = [[np.zeros(0, d) for _ in range(n)] for d in ("i8", "i8", bool)]

    def least(self, q: int) -> int:
        """What a document must reach to be among them."""
        return int(self.scores[q][-1]) if len(self.scores[q]) == self.k else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        scores, ids, named = (np.concatenate(x) for x in ((self.scores[q], scores), (self.ids[q], ids), (self.named[q], named)))
        best = np.lexsort((ids, named, -scores))[: self.k]
        self.scores[q], self.ids[q], self.named[q] = scores[best], ids[best], named[best]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.scores]
        ids = pa.array(np.concatenate(self.ids), mask=~np.concatenate(self.named))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes)), ids, pa.array(np.concatenate(self.scores))], ["q", "doc_id", "score"])


def first_visits(chunks: DataFrame, block: Block, n: int) -> list[tuple[int, int]]:
    """The (m, chunk) of each query's n greatest bounds: at most n a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys = [], []
        for batch in batches:
            for row in range(batch.num_rows):
                found.append(block.bounds(batch, row)[1])
                keys.append((batch.column("m")[row].as_py(), batch.column("chunk")[row].as_py()))
            if found:
                bounds, keys_ = np.array(found), np.array(keys)
                top = np.argsort(-bounds, axis=0, kind="stable")[:n]
                q = np.tile(np.arange(bounds.shape[1]), len(top))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.take_along_axis(bounds, top, 0).ravel()), pa.array(keys_[top.ravel(), 0]), pa.array(keys_[top.ravel(), 1])], ["q", "bound", "m", "chunk"])
                found, keys = [], []

    rows = chunks.select("m", "chunk", "terms", "max_tf").mapInArrow(run, "q long, bound long, m long, chunk long").filter("bound > 0")
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "m", "chunk")
    picked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("m", "chunk").distinct()
    return [tuple(r) for r in picked.collect()]


def scored(chunks: DataFrame, block: Block, least: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): the k best documents of each query of the chunks; several tasks may give k each. A chunk whose
    bound for a query is under what the query's k-th document has (least, or what the task has found) isn't visited."""

    def visit(batch: pa.RecordBatch, row: int, best: Best) -> None:
        at, bounds = block.bounds(batch, row)
        todo = [q for q in np.flatnonzero(bounds > 0).tolist() if bounds[q] >= max(least[q], best.least(q))]
        if not todo:
            return
        m, n_docs = batch.column("m")[row].as_py(), batch.column("n_docs")[row].as_py()
        df, counts, tfs, docs, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("df", "<i4"), ("counts", "<i4"), ("tfs", "<i4"), ("docs", "<i4"), ("doc_ids", "<i8")))
        nulls = int(ids[0])
        ids = np.concatenate([np.zeros(nulls, "i8"), ids[1:]])
        named = np.arange(n_docs) >= nulls
        ends, group_ends = np.cumsum(df), np.cumsum(counts)
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in todo:
            score = np.zeros(n_docs, "i8")
            for t in block.queries[q].tolist():
                if at[t] < 0 or not block.weights[t]:
                    continue
                if t not in lists:
                    end = int(ends[at[t]])
                    start = end - int(df[at[t]])
                    a, b = np.searchsorted(group_ends, [start, end - 1], side="right")
                    lists[t] = docs[start:end], np.repeat(impacts(int(block.weights[t]), tfs[a : b + 1], m), counts[a : b + 1])
                score[lists[t][0]] += lists[t][1]
            floor = max(least[q], best.least(q))
            if n_docs > k:
                floor = max(floor, int(np.partition(score, n_docs - k)[n_docs - k]))
            top = np.flatnonzero(score >= floor)
            if len(top):
                best.add(q, score[top], ids[top], named[top])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.queries), k)
        for batch in batches:
            for row in range(batch.num_rows):
                visit(batch, row, best)
        yield best.batch()

    return chunks.mapInArrow(run, "q long, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(index: Index, queries: list[list[str]], k: int, first: int = FIRST) -> DataFrame:
    """(q, doc_id, score, rank) of a block of queries, each a list of distinct terms; q is its place."""
    terms = sorted({t for q in queries for t in q})
    df = frequencies(index.chunks, terms)
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in terms], "i8")
    place = {t: i for i, t in enumerate(terms)}
    block = Block(terms, weights, [np.array([place[t] for t in q], "i8") for q in queries])
    least = np.ones(len(queries), "i8")
    visits = first_visits(index.chunks, block, first)
    if visits:
        named = index.chunks.sparkSession.createDataFrame(visits, "m long, chunk long")
        near = best_of(scored(index.chunks.join(F.broadcast(named), ["m", "chunk"], "left_semi"), block, least, k), k)  # at most `first` chunks a query
        for r in near.filter(F.col("rank") == k).select("q", "score").collect():  # a row per query
            least[r["q"]] = r["score"]
    return best_of(scored(index.chunks, block, least, k), k)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK_QUERIES, block_terms: int = 50_000) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries the k documents of the greatest score above 0.

    Equal scores go by ascending doc_id, null ids first. A query's terms count once each; a null text, or one without terms,
    gives no row. Rows that repeat an item are ranked each. Queries go to the tasks in blocks of so many queries, or of
    about so many terms (a longer query is a block of its own); one block at a time is on the driver.
    """
    spark = queries.sparkSession
    kind = queries.schema[id_col].dataType
    parts: list[DataFrame] = []
    ids: list[object] = []
    lists: list[list[str]] = []

    def flush() -> None:
        found = search_block(index, lists, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"q long, item_id {kind.simpleString()}")
        parts.append(written(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))  # the block's names
        ids.clear()
        lists.clear()

    if index.n_docs:
        for r in queries.select(id_col, text_col).toLocalIterator():
            terms = sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(r[1])})
            if terms:
                if lists and (len(lists) == block or sum(map(len, lists)) + len(terms) > block_terms):
                    flush()
                ids.append(r[0])
                lists.append(terms)
        if lists:
            flush()
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
