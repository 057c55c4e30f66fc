"""Session-level settings shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHUNK_ROWS = "packetloom.chunkRows"
DEFAULT_CHUNK_ROWS = 1 << 19
#: Spark's own defaults, which say nothing of what a user wants.
BATCH_BYTES, BATCH_ROWS = "67108864b", "10000"

_private: dict[str, str] = {}


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def chunk_rows() -> int:
    """Rows of capture order that one ordered task may hold, whatever the key."""
    return int(session().conf.get(CHUNK_ROWS, str(DEFAULT_CHUNK_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; all executors share it.

    Without that setting only a local master may go on, in a private folder that is removed when the
    process ends. On a cluster each executor would write to its own disk, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        application = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local") or \
                spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _private:
            _private[application] = tempfile.mkdtemp(prefix="packetloom-")
            atexit.register(shutil.rmtree, _private[application], ignore_errors=True)
        folder = _private[application]
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20, most_rows: int = 2000) -> None:
    """Bound the Arrow batches that Python workers of this session get from now on, where a user has not.

    A batch stands in memory several times over, outside of Spark's heap, for every running task.
    """
    for name, most, usual in (("maxBytesPerBatch", most_bytes, BATCH_BYTES), ("maxRecordsPerBatch", most_rows, BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, usual) in (usual, ""):
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/packetloom/{name}-{uuid.uuid4().hex}"


def settle(df, name: str):
    """Write an intermediate table to the shared folder and go on from the files.

    Used where a result feeds several ordered passes: they read the table instead of repeating the
    work behind it, and a lost executor costs one read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_in = path
    return out


def settle_clustered(df, name: str, key: str, buckets: int):
    """Write an intermediate table bucketed and sorted by a key, so that joins on it need no exchange of this side.

    The rows should come dealt by the key already, else every task writes a file for each bucket. The table has a
    name in the session's catalogue and its files in the shared folder; `discard` takes both away.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"packetloom_{path.rpartition('/')[2].replace('-', '_')}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._settled_in, out._table = path, table
    return out


def discard(*tables) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for table in tables:
        if getattr(table, "_table", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._settled_in)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
