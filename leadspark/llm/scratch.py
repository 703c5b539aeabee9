"""Tables that cut lineage: written under the shared checkpoint folder and read back.

A written table survives the loss of executors, has exact size statistics for
join planning, and gives both sides of a later join exchanges of their own, which
adaptive execution can split when one key is hot.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of the batches that Spark hands to Python, see small_batches().
BATCH = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Spark now hands at most about BATCH bytes (one row at least) to Python at a time, unless a bound is set there.

    Spark's own bound is 64 MB: it holds such a batch as columns and once more as the
    message to the worker, outside the heap, and the worker holds it too. No result
    depends on the bound, which counts when a plan runs.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (single machine), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of one job's intermediate tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.written: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a reader of what was written."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written[id(out)] = path
        return out

    def done(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more: whatever was made of them must have been written."""
        for t in tables:
            self.drop(self.written.pop(id(t)))

    def drop(self, path: str) -> None:
        """Removes one folder of this job."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def kept(shared, name: str, make):
    """make(content) of a broadcast dict, made once in a worker: later tasks find it in the broadcast value.

    Broadcast values are plain, since workers need not have this package: what is made
    of them stays out of the pickled form.
    """
    value = shared.value
    if name not in value:
        value[name] = make(value["content"])
    return value[name]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made of name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str):
    """A column that tells rows apart that repeat an id: the id, then a checksum of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.col(id_col).alias("id"), F.md5(text).alias("text"))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose row_key is in gone(doc_id); columns unchanged."""
    name = fresh(docs, "gone")
    own = gone.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(own.hint("merge"), row_key(id_col, text_col) == F.col(name), "left_anti")
