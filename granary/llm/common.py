"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.sources.shared import new_path, shared_dir, written  # noqa: F401

#: White space of all word and normalisation rules here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: A right side with at most this many rows is broadcast; one with more is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """From now on, Arrow batches of the session hold about size bytes at most: a batch of whole texts takes several times
    its size outside the heap while it is built and sent. A limit that a site has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(key, str(size))


def sized(batch: pa.RecordBatch, column: str, size: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows at most and of about size bytes in a text column, one row at least: Python
    holds several copies of a slice's texts."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.cumsum(lengths, dtype="i8")
    at = 0
    while at < batch.num_rows:
        had = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, had + size, side="right")), at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


class Kept:
    """Lists of 32-bit integers by name, at most `most` of them: those used last. Arrow holds them, so that a name takes
    tens of bytes, and Python sees each new name once."""

    def __init__(self, most: int) -> None:
        self.most, self.turn = most, 0
        self.names, self.lists, self.used = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.zeros(0, "i4")

    def of(self, names: pa.Array, learn: Callable[[list[str]], pa.ListArray]) -> pa.ListArray:
        """The lists of distinct names; learn gives those of names that aren't held."""
        self.turn += 1
        at = pc.index_in(names, self.names)
        new = names.filter(at.is_null())
        if len(self.names) + len(new) > self.most:
            half = len(self.used) // 2
            stays = self.used >= np.partition(self.used, half)[half] if half and len(new) < self.most // 2 else np.zeros(len(self.used), bool)
            stays[at.drop_null().to_numpy()] = True
            stays = pa.array(stays)
            self.names, self.lists, self.used = self.names.filter(stays), self.lists.filter(stays), self.used[stays.to_numpy(zero_copy_only=False)]
            at = pc.index_in(names, self.names)
        if len(new):
            fresh_at = np.cumsum(at.is_null().to_numpy(zero_copy_only=False), dtype="i4") + np.int32(len(self.names) - 1)
            at = pc.if_else(at.is_null(), pa.array(fresh_at), at)
            self.names = pa.concat_arrays([self.names, new])
            self.lists = pa.concat_arrays([self.lists, learn(new.to_pylist())])
            self.used = np.concatenate([self.used, np.zeros(len(new), "i4")])
        self.used[at.to_numpy()] = self.turn
        return self.lists.take(at)


def list_array(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths, their 32-bit values one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4")), pa.array(values))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_shuffle(right: DataFrame) -> DataFrame:
    """The right side of a join that must not be broadcast: it grows with the corpus, and Spark would judge by its compressed
    files, without the copies that a salt makes of each row."""
    return right.hint("merge")


def lookup_join(left: DataFrame, right: DataFrame, key: str, n_right: int, how: str = "left", salts: int = 64) -> DataFrame:
    """Join to a lookup table whose row count is known: broadcast when small, else by a salted shuffle.

    The salt splits a key that holds a large part of the left rows over that many tasks; where the left keys are unique, one
    will do.
    """
    if n_right <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salt = fresh(left, "salt")
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(by_shuffle(spread), [key, salt], how).drop(salt)


def counted_join(left: DataFrame, right: DataFrame, key: str | list[str], n_rows: str, hot: int = 10_000, most: int | None = None) -> DataFrame:
    """Left join to a written table with a row per key, whose column n_rows has how many rows of left hold the key.

    The table is broadcast when it has few rows. Else its hottest keys, `most` (BROADCAST_ROWS) at most and each of more than `hot` rows, are
    broadcast, and the others joined by a shuffle: none of these holds more than a part in `most` of the rows, or than
    `hot`."""
    keys, most = [key] if isinstance(key, str) else key, most or BROADCAST_ROWS
    n = right.count()
    if n <= most:
        return left.join(F.broadcast(right), keys, "left")
    many = right.filter(F.col(n_rows) > hot)
    n_many = many.count()
    if n_many > most:
        least = many.select(F.percentile_approx(n_rows, 1 - most / (2 * n_many), 10 * most).alias("x")).first()["x"]
        hot = max(hot, least)
        many = right.filter(F.col(n_rows) > hot)
    rest = left.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(by_shuffle(right.filter(F.col(n_rows) <= hot)), keys, "left")
    return left.join(F.broadcast(many), keys).unionByName(rest)


def unit(*parts: Column | str, digits: int = 13) -> Column:
    """A hash of the parts as a double in (0, 1): md5's first hex digits, so that other engines compute it too."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    value = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("double")
    return (value + F.lit(0.5)) / F.lit(float(16**digits))


def carried(docs: DataFrame, inputs: Sequence[Column], carry: Sequence[str], added: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, list[pa.Array]]]]) -> DataFrame:
    """Apply run to Arrow batches of the inputs (named x0, x1, ...): it yields, in the rows' order, how many rows it
    has done and the arrays of the added columns. The result has the carried columns as they are, then the added ones;
    an added name that a carried column has gets an underscore."""
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], *[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    schema = StructType([*StructType([named.schema[f"c{i}"] for i in range(len(carry))]), *StructType.fromDDL(added)])
    width, names = len(carry), schema.names
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield batch

        at = 0
        for n, arrays in run(seen()):
            if at == waiting[0].num_rows:
                waiting.pop(0)
                at = 0
            part = waiting[0].slice(at, n)
            at += n
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names)

    out = named.mapInArrow(work, schema)
    taken = list(carry)
    for name in StructType.fromDDL(added).names:
        while name.lower() in {c.lower() for c in taken}:
            name += "_"
        taken.append(name)
    return out.toDF(*taken)


def without(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left whose keys (left's name to right's) aren't in right; nulls are equal. right is a written table:
    broadcast with at most BROADCAST_ROWS rows, else joined by a shuffle."""
    names = {r: fresh(left, f"{r}_gone") for r in keys.values()}
    other = right.select(*[F.col(r).alias(n) for r, n in names.items()])
    other = F.broadcast(other) if right.count() <= BROADCAST_ROWS else by_shuffle(other)
    same = [F.col(k).eqNullSafe(F.col(names[r])) for k, r in keys.items()]
    return left.join(other, same, "left_anti")
