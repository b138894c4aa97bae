"""A stored table of documents that changes are merged into, bucket by bucket."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a change holds: deleted marks that the document goes; null is false.
COLUMNS = ("document_id", "version", "kind", "text", "deleted")
#: Tasks, and files, that a bucket is dealt to.
PARTS = 4


class DocumentStore:
    """Documents by id, of each the row of the greatest version (of equal ones, that of the greatest text).

    A document's bucket is a hash of its id. An upsert reads and rewrites the buckets of its documents alone, into a folder
    of its own; then it writes the list of all buckets' folders, which is what readers follow, under the next number. So a
    reader sees all of an upsert or nothing, and one that fails leaves what was there. Deletions stay as marks, so that an older
    version that comes late doesn't bring a document back. One writer at a time. Buckets should hold some 100 MB."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int) -> None:
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets

    def files(self) -> DataFrame | None:
        """(bucket, folder, n_buckets) of the last upsert; None if there was none."""
        try:
            lists = self.spark.read.parquet(f"{self.path}/lists")
        except AnalysisException:
            return None
        last = lists.agg(F.max("number").alias("n")).first()["n"]
        found = lists.filter(F.col("number") == last).select("bucket", "folder", "n_buckets", "number")
        if found.filter(F.col("n_buckets") != self.n_buckets).limit(1).count():
            raise ValueError(f"the store has another number of buckets than {self.n_buckets}")
        return found

    def rows(self, files: DataFrame | None) -> DataFrame | None:
        folders = [r["folder"] for r in files.select("folder").distinct().collect()] if files is not None else []  # one per bucket at most
        return self.spark.read.parquet(*folders) if folders else None

    def current(self) -> DataFrame | None:
        """(document_id, version, kind, text) of the documents that are there."""
        found = self.rows(self.files())
        return None if found is None else found.filter("NOT deleted").select(*COLUMNS[:-1])

    def merged(self, rows: DataFrame) -> DataFrame:
        """The last row of each document (bucket, COLUMNS). Texts are shuffled once: documents meet where their part of a
        bucket is written, PARTS files a bucket."""
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "document_id"), F.lit(PARTS))).repartition("bucket", "part")
        last = F.max(F.struct("version", "text", "kind", "deleted")).alias("x")
        return dealt.groupBy("bucket", "part", "document_id").agg(last).select("bucket", "document_id", "x.version", "x.kind", "x.text", "x.deleted")

    def upsert(self, changes: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(self.n_buckets)).cast("int")
        new = changes.select(*COLUMNS).withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # n_buckets at most
        if not touched:
            return
        files = self.files()
        number = 0 if files is None else files.first()["number"] + 1
        old = None if files is None else self.rows(files.filter(F.col("bucket").isin(touched)))
        all_ = new if old is None else new.unionByName(old.withColumn("bucket", bucket))
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        self.merged(all_).write.partitionBy("bucket").parquet(folder)
        listed = self.spark.createDataFrame([(b, f"{folder}/bucket={b}") for b in touched], "bucket int, folder string")
        if files is not None:
            listed = listed.unionByName(files.filter(~F.col("bucket").isin(touched)).select("bucket", "folder"))
        listed.select("bucket", "folder", F.lit(self.n_buckets).alias("n_buckets")).coalesce(1).write.parquet(f"{self.path}/lists/number={number}")
