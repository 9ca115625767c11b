"""Shared scratch space: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: On a local disk, Hadoop's default starts a chmod process for every file and checksum file that it creates, each with the
#: executor's whole memory until it execs; the plain file system does not.  Other stores are left as they are.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one of our own, in local mode only."""
    set_ = spark.conf.get(_KEY, "") or ""
    if not set_:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        set_ = "file://" + tempfile.mkdtemp(prefix="geoshroud-")
        spark.conf.set(_KEY, set_)
    return set_.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Named tables below one fresh folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it reread: a lost executor costs a reread, not the whole lineage."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.options(compression="zstd", **_PLAIN).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def append_keyed(self, df: DataFrame, table: str, key: str) -> DataFrame:
        """Append ``df`` to a table in buckets of ``key`` and return the whole table: joins on ``key`` read it where it lies,
        so its rows are dealt once in place of once for each join.  ``drop_keyed`` deletes it."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.spark.catalog.tableExists(table):  # the bucket count is that of the first rows
            n = int(self.spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Num Buckets'").first()["data_type"])
        rows = df.repartition(n, key).write.format("parquet").mode("append").options(compression="zstd", path=f"{self.root}/{table}", **_PLAIN)
        rows.bucketBy(n, key).sortBy(key).saveAsTable(table)
        return self.spark.table(table)

    def drop_keyed(self, table: str) -> None:
        """Delete a table of ``append_keyed`` with its name."""
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark's cleaner remove dead shuffle files."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.reclaim()

    def reclaim(self) -> None:
        """Shuffle files go once the driver's garbage that refers to them is collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows: whole texts can be long, and a batch is held in memory at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
