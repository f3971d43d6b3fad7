"""Tables written once to shared storage and read again: for what several parts of a job need, at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, deleted when the session's JVM ends. Where that is unset, a temporary one if all tasks run on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaylight-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quaylight-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path if "://" in path else "file://" + path if path.startswith("/") else path


def save(df: DataFrame) -> DataFrame:
    """df as a table of its own. Lost executors cost nothing that was saved, and no block is kept in their memory."""
    folder = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/table")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    out._saved_in = folder
    return out


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, whose rows can be counted cheaply (a saved or given table), dealt by keys into parts of some `rows` rows.

    Parts that Spark sizes itself are by compressed bytes, so small rows that look alike come millions to a task.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


#: Compressed bytes that one task shuffles in and reads, at most, of rows that look alike.
SHUFFLED_A_TASK, READ_A_TASK = 4 << 20, 32 << 20


def small_parts(spark: SparkSession) -> None:
    """Lets the session's tasks take no more than SHUFFLED_A_TASK and READ_A_TASK, or less where less is set.

    Rows of small repositories shrink some seventyfold when they are shuffled or saved, so Spark's own 64 and 128 MB
    would be gigabytes to sort in one task, and more of them the larger the input is.
    """
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED_A_TASK), ("spark.sql.files.maxPartitionBytes", READ_A_TASK)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))


def discard(*tables: DataFrame) -> None:
    """Deletes tables of save() that nothing will read again."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._saved_in)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
