"""Token-id files: Parquet with one list of ids per document, in ascending order of doc_id.

Documents are dealt to files by ranges of doc_id and sorted there, encoded in Arrow batches, and written by Spark's own
Parquet writer: ids dictionary-encoded, doc_id and seq delta-encoded, row groups and pages of set sizes, page indexes
on. A reader that wants some documents' tokens, or only the counts, skips the other pages and columns.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, list_array, new_path, sized

TOKENS = "file_no int, seq long, doc_id long, n_tokens long, tokens array<int>"
#: Texts with none of these take the quick way below: their characters are their own NFC form and have no case exceptions.
UNUSUAL = r"[^\t-\r\x20-\x7e\x{a1}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{ff}]|<\|"
#: The vocabulary's word rule for those characters, in lower case.
PIECES = r"[a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}0-9]+"
#: The normaliser and the word rule of a vocabulary file that UNUSUAL and PIECES stand for.
QUICK_NORMALIZER = ["NFC", "Replace", "Lowercase"]
QUICK_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a text. White space cuts it off, and no text on the quick way has it.
END = "\x01"
#: Bytes of text in one batch of the encoder: more repeat fewer words, and take more memory.
BATCH = 3 << 20

_encoders: dict[tuple[str, int, float, int], Encoder] = {}


class Encoder:
    """Encodes with the tokenizers library; what the parts of words give is kept, as they recur: `most` of them, those
    used last. Other vocabularies than the quick way's are encoded text by text."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), Kept(most)
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        normalizers = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"].get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.quick = bool(suffix) and normalizers == QUICK_NORMALIZER and splits == [QUICK_WORDS]
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        for word, i in words.items():
            self.ends[i] = bool(suffix) and word.endswith(suffix)

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """This process's encoder of the file as it is now."""
        seen = os.stat(path)
        key = (path, seen.st_size, seen.st_mtime)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = cls(path)
        return _encoders[key]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")

    def learned(self, parts: list[str]) -> pa.ListArray:
        """The ids of parts, each one word to the library: encoded together, cut where a word ends."""
        found, counts = [], []
        for at in range(0, len(parts), 500):
            some = parts[at : at + 500]
            ids = self.ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                found.append(ids)
                counts.append(np.diff(cuts, prepend=0))
            else:
                each = [self.ids(p) for p in some]
                found += each
                counts.append(np.array([len(x) for x in each]))
        return list_array(np.concatenate(counts), np.concatenate(found))

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and end_id, as 32-bit integers.

        Arrow splits and numbers words, then the distinct words' parts, and gathers their ids, so that Python sees each
        new part once. A text that can't be split this way is one word, named by its place."""
        odd = pc.match_substring_regex(texts, UNUSUAL) if self.quick else pa.repeat(pa.scalar(True), len(texts))
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(pc.utf8_lower(pc.if_else(odd, "", texts)), END, " "))
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        split = pc.ascii_split_whitespace(pc.utf8_rtrim_whitespace(pc.replace_substring_regex(coded.dictionary, f"({PIECES})", r"\1 ")))
        parts = split.flatten().dictionary_encode()
        each = self.kept.of(parts.dictionary, self.learned).take(parts.indices)
        words = pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[split.offsets.to_numpy()]), each.values)
        # The ends of texts: end_id, after the ids of a text that stands apart.
        ends = [np.array([end_id], "<i4"), *(np.append(self.ids(texts[i].as_py()), np.int32(end_id)) for i in apart.tolist())]
        first = len(words)
        table = pa.concat_arrays([words, list_array([len(x) for x in ends], np.concatenate(ends))])
        codes = coded.indices.to_numpy().copy()
        codes[offsets[1:] - 1] = first
        codes[offsets[apart + 1] - 1] = first + 1 + np.arange(len(apart))
        found = table.take(pa.array(codes))
        return pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[offsets]), found.values)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 32, page_kb: int = 64) -> None:
    """Encode every whole text, append end_id, and write the files under path.

    A null text is encoded as empty, hence gives end_id alone. Null ids come first; rows that repeat an id are written
    as often as they occur, in a fixed order by their text's hash. A long text is encoded whole. Other columns aren't read, whatever their names. An
    empty table gives files without rows.
    """
    tie = "tie"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(tie, F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).select(F.spark_partition_id().alias("file_no"), "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, seq = Encoder.of_process(vocabulary), 0
        for batch in batches:
            for part in sized(batch, "text", BATCH):
                tokens = encoder.encode(part.column("text"), end_id)
                numbers = pa.array(np.arange(seq, seq + part.num_rows))
                seq += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("file_no"), numbers, part.column("doc_id"), pc.list_value_length(tokens).cast("i8"), tokens], ["file_no", "seq", "doc_id", "n_tokens", "tokens"])

    writer = dealt.mapInArrow(encode, TOKENS).write
    for key, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#seq": "false",
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, seq, doc_id, n_tokens, tokens) of files under path; seq numbers a file's rows in their order."""
    return spark.read.schema(TOKENS).parquet(path)


def token_index(files: DataFrame) -> DataFrame:
    """From the files' rows: (doc_id, start, n_tokens, ids_crc32, file_no).

    start counts the ids of all documents before this one, ids_crc32 is the CRC-32 of the ids as little-endian unsigned
    32-bit integers. Sums run inside a file; the files' totals, a row each, are summed over the files.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("file_no", "seq", "doc_id")), pa.array(np.diff(offsets).astype("i8")), pa.array(crcs, pa.int64())], ["file_no", "seq", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("file_no", "seq", "doc_id", "tokens").mapInArrow(digest, "file_no int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file_no", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(F.broadcast(starts), "file_no")  # a row per file
    return summed.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file_no")


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files to the shared folder and index what is read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)
    return token_index(read_tokens(docs.sparkSession, path))
