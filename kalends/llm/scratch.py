"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own is set and kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.kalends.scratch", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] == "local":  # one process, so nothing else needs to see it
            folder = tempfile.mkdtemp(prefix="kalends-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kalends"
        spark.conf.set("spark.kalends.scratch", folder)
    return folder.rstrip("/")


#: Rows and bytes of the Arrow batches that tasks exchange with Python, so that a batch of long texts stays small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("64MB", "4MB")}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCHES for the session, as results are computed after an operator returns; what the caller has set stays."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) in (default, str(64 << 20)):
            spark.conf.set(key, ours)


class Scratch:
    """Tables of one operator run: written once, so that later jobs neither recompute them nor depend on one executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._next = 0
        self._places: list[str] = []

    def write(self, df: DataFrame, name: str = "t", by: str | None = None, bucketed: str | None = None) -> DataFrame:
        """Writes `df` as Parquet, in a folder for each value of `by`, and gives a DataFrame over the files; its shuffle files go before the next is written.

        With `bucketed`, a key column, it is a table in as many buckets as there are shuffle partitions, so that what is
        grouped by that key later isn't shuffled. The catalog's entry stays, as results are computed after an operator returns.
        """
        # the caller has let go of what was written before, so its shuffle files go before this needs as many
        self.release()
        path = f"{self.root}/{name}-{self._next}"
        self._next += 1
        schema, table = df.schema, f"kalends_{uuid.uuid4().hex}"
        if bucketed:
            to = df.write.format("parquet").bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucketed)
            (to.partitionBy(by) if by else to).option("path", path).saveAsTable(table)
        else:
            df.write.parquet(path, partitionBy=by)
        self._places.append(path)
        out = self.spark.table(table) if bucketed else self.spark.read.schema(schema).parquet(path)
        out._kalends_path, out._kalends_bucketed = path, bool(bucketed)
        return out

    def part(self, table: DataFrame, folder: str) -> DataFrame:
        """One folder of a table written with `by`, which can be dropped alone."""
        path = f"{table._kalends_path}/{folder}"
        schema = table.drop(folder.split("=")[0]).schema
        if table._kalends_bucketed:
            out = table.where(folder).drop(folder.split("=")[0])
            out._kalends_path = path
            return out
        place, files = self._file_system(path)
        out = self.spark.read.schema(schema).parquet(path) if files.exists(place) else self.spark.createDataFrame([], schema)
        out._kalends_path = path
        return out

    def release(self) -> None:
        """Lets Spark's cleaner find the shuffles of DataFrames that are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, table: DataFrame) -> None:
        """Deletes a table that no DataFrame to come reads."""
        self._delete(table._kalends_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables but those that the result reads."""
        kept = [t._kalends_path for t in tables]
        for path in self._places:
            if not any(k == path or k.startswith(path + "/") for k in kept):
                self._delete(path)
        self._places = [p for p in self._places if any(k == p or k.startswith(p + "/") for k in kept)]
        self.release()

    def _delete(self, path: str) -> None:
        place, files = self._file_system(path)
        files.delete(place, True)

    def _file_system(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A setting for the jobs that run within, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
