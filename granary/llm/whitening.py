"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Centred rows X are bidiagonalised from a random start: alternating distributed products X v and X' u with full
reorthogonalisation of both sides give X V = U R and X' U = V B', R upper triangular (bidiagonal but for the corrections
of rounding). The small matrix's singular value decomposition gives components and deviations. Rows are packed once into
blocks of binary columns; each step is one pass over them that returns a vector of about the vectors' length. The long
vectors u are never stored: a task replays them for its rows from V and R. Found components are deflated and the process
is started again until what is left has no greater deviation, so that equal deviations are found as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, written

#: An entry c of a vector counts as floor(SCALE * c) + SHIFT; at most LARGEST on either side.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 40)
#: Rows of one packed block.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n rows with per-dimension sums S; row i of components is the unit vector of the i-th greatest variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of whole numbers; a vector that is shorter than width is filled up with entries of 0."""
    values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype("i8") + SHIFT
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype("i8")
    if len(lengths) and (lengths == width).all():
        return whole.reshape(-1, width)
    out = np.full((len(lengths), width), SHIFT, "i8")
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def packed(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """(n, x): blocks of rows, x their whole numbers one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = integers(batch.column(0).slice(at, BLOCK_ROWS), width)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["n", "x"])

    return written(rows.select(vector).mapInArrow(run, "n long, x binary"), "blocks")


def summed(blocks: DataFrame, of: object, length: int) -> np.ndarray:
    """The sum of of(x), an array of so many doubles, over all blocks x (rows by columns, whole numbers): summed in each
    task, then over the tasks by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x"), strict=True):
                total += of(np.frombuffer(x.as_buffer(), "i8").reshape(n, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], ["k", "v"])

    out = np.zeros(length)
    for row in blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row per number
        out[row["k"]] = row["v"]
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact n * x - S where that fits 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return (n * x - sums) / n
    return (x - sums // n) - (sums % n) / n


class Bidiagonalisation:
    """One run of the process on the centred rows, orthogonal to given directions (locked, as rows). What is below the
    rounding of scale, the greatest singular value known, counts as nothing."""

    def __init__(self, blocks: DataFrame, n: int, sums: np.ndarray, locked: np.ndarray, scale: float, random: np.random.Generator) -> None:
        self.blocks, self.n, self.sums, self.locked = blocks, n, sums, locked
        self.v, self.r, self.xtu = np.zeros((0, len(sums))), np.zeros((0, 0)), np.zeros((0, len(sums)))
        self.next, self.beta, self.scale = self.orthogonal(random.standard_normal(len(sums)))[0], 0.0, scale

    def orthogonal(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """x without what lies in the directions so far, scaled to 1, and its length."""
        for _ in range(3):
            for basis in (self.locked, self.v):
                x = x - basis.T @ (basis @ x)
        length = float(np.linalg.norm(x))
        return x / length if length else x, length

    def step(self) -> bool:
        """One more column of U, R and V; False if nothing is left."""
        k, n, sums = len(self.v), self.n, self.sums
        v, r, new = self.v, self.r, self.next

        def product(coefficients: np.ndarray) -> np.ndarray:
            """Of q = X new - U c, with u replayed for a block's rows: U'q, X'q and q'q."""

            def of(x: np.ndarray) -> np.ndarray:
                rows = centred(x, n, sums)
                images, u = rows @ v.T, np.zeros((len(rows), k))
                for j in range(k):
                    u[:, j] = (images[:, j] - u[:, :j] @ r[:j, j]) / r[j, j]
                q = rows @ new - u @ coefficients
                return np.concatenate([u.T @ q, rows.T @ q, [q @ q]])

            return summed(self.blocks, of, k + len(sums) + 1)

        c = np.zeros(k)
        if k:
            c[-1] = self.beta
        for _ in range(3):  # the first pass nearly always suffices: what is left to take off is rounding
            found = product(c)
            more, xtq, square = found[:k], found[k:-1], found[-1]
            c = c + more
            left = square - more @ more
            if more @ more <= 1e-4 * square:
                break
        self.scale = max(self.scale, np.sqrt(max(square, 0.0)), self.beta)
        alpha = np.sqrt(max(left, 0.0))
        if alpha <= 1e-13 * self.scale or not alpha:  # X new lies in U: the process ends with an exact R
            self.r, self.v, self.beta = np.hstack([r, c[:, None]]), np.vstack([v, new]), 0.0
            return False
        self.r = np.block([[r, c[:, None]], [np.zeros((1, k)), np.array([[alpha]])]])
        image = (xtq - self.xtu.T @ more) / alpha  # X'u of the new u
        self.xtu, self.v = np.vstack([self.xtu, image]), np.vstack([v, new])
        self.next, self.beta = self.orthogonal(image)
        return True

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values of X so far, their right vectors as rows, and bounds of their errors."""
        left, values, right = np.linalg.svd(self.r, full_matrices=False)
        return values, right @ self.v, self.beta * np.abs(left[-1:]).sum(0)


def leading(blocks: DataFrame, n: int, sums: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest singular values of the centred rows and their right vectors as rows; fewer if no more are above 0."""
    width, random = len(sums), np.random.default_rng(seed)
    values, vectors = np.zeros(0), np.zeros((0, width))
    while len(vectors) < width:
        run = Bidiagonalisation(blocks, n, sums, vectors, float(values.max(initial=0.0)), random)
        known = len(vectors) >= k
        wanted, exact = (1, 1e-9) if known else (k, 2e-16)
        found, right, errors = np.zeros(0), np.zeros((0, width)), np.zeros(0)
        while len(run.v) + len(vectors) < width:
            going = run.step()
            found, right, errors = run.triples()
            if not going or (len(found) >= wanted and (errors[:wanted] <= exact * found[0]).all()) or run.beta <= 1e-15 * run.scale:
                break
        found, right = found[found > 0], right[found > 0]
        if not len(found) or (known and found[0] <= values[k - 1] * (1 + 1e-12)):
            break  # what is left has no greater deviation
        if known:  # some equal deviation was hidden from the first start: find it to full precision
            while len(run.v) + len(vectors) < width and run.beta > 1e-15 * run.scale and errors[0] > 2e-16 * found[0] and run.step():
                found, right, errors = run.triples()
        whole = len(run.v) + len(vectors) >= width
        right = right[: len(found)]
        take = np.ones(len(found), bool) if whole or run.beta <= 1e-15 * run.scale else errors[: len(found)] <= 2e-15 * found[0]
        if not take.any():
            break
        values, vectors = np.concatenate([values, found[take]]), np.vstack([vectors, right[take]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
        if whole:
            break
    least = 1e-12 * values[0] if len(values) else 0.0
    stays = np.flatnonzero(values > least)[:k]
    return values[stays], vectors[stays]


def whitened_block(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.variances)[:, None]).T


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = 8, seed: int = 7) -> Whitening | None:
    """The whitening of all rows whose vector is finite (others are left out); None without such rows.

    A vector that is shorter than the longest one is filled up with zeros. Directions without variance are no components,
    so that equal rows give none. Sums and norms are taken over every row; the driver holds vectors of one row's length.
    """
    rows = vectors.filter(finite(F.col(vector_col))).select(F.col(vector_col).alias("v"))
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"]
    if not width:
        return None
    blocks = packed(rows, "v", width)
    total = blocks.agg(F.sum("n").alias("n")).first()["n"]

    def halves(x: np.ndarray) -> np.ndarray:  # exact as doubles: sums of 2^20 times and of the rest
        return np.concatenate([(x >> 20).sum(0), (x & 0xFFFFF).sum(0)]).astype("f8")

    high, low = summed(blocks, halves, 2 * width).reshape(2, width)
    sums = np.array([(int(a) << 20) + int(b) for a, b in zip(high, low, strict=True)], "i8")
    trace = summed(blocks, lambda x: np.array([(centred(x, total, sums) ** 2).sum()]), 1)[0] / total
    values, components = leading(blocks, total, sums, k, seed)
    model = Whitening(total, sums, components, values**2 / total, trace)
    many = len(values)
    if not many:
        return model
    means = summed(blocks, lambda x: whitened_block(x, model).sum(0), many) / total

    def products(x: np.ndarray) -> np.ndarray:
        y = whitened_block(x, model) - means
        return (y.T @ y).ravel()

    error = np.abs(summed(blocks, products, many * many).reshape(many, many) / total - np.eye(many)).max()
    return Whitening(total, sums, components, model.variances, trace, float(error))


def transform(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", carry: Sequence[str] | None = None) -> DataFrame:
    """The carried columns (all by default), `whitened` (a double per component) and `deviation`, the exact sum over the
    dimensions of (n * x - S)^2, null where that exceeds a long. Rows whose vector isn't finite, or is longer than the
    model's, are left out. An added name that is taken gets an underscore; repeated rows give repeated rows."""
    n, sums, width = model.n, model.sums, len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = integers(batch.column("x0").slice(at, BLOCK_ROWS), width)
                y = whitened_block(x, model)
                most = max((abs(n * int(a) - int(s)) for e in (x.min(0), x.max(0)) for a, s in zip(e, sums, strict=True)), default=0)
                if most * most * width < 1 << 63:
                    exact = ((n * x - sums) ** 2).sum(1).tolist()
                else:
                    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
                deviations = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                offsets = pa.array(np.arange(len(y) + 1, dtype="i4") * y.shape[1])
                yield len(x), [pa.ListArray.from_arrays(offsets, pa.array(y.ravel())), deviations]

    rows = vectors.filter(finite(F.col(vector_col)) & (F.size(vector_col) <= width))
    return carried(rows, [F.col(vector_col)], list(vectors.columns) if carry is None else carry, "whitened array<double>, deviation long", run)


def whitened(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row with a finite vector and
    component, numbered from 1. An empty table, or one of equal vectors, gives an empty result. A null id stays."""
    ids = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    model = fit(ids, k=k)
    if model is None or not len(model.variances):
        kind = ids.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    rows = transform(ids, model, carry=["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
