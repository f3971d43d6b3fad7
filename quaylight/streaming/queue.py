"""Submissions as a stream: JSON files that arrive in a folder are taken in order of creation, and each batch is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaylight.sources.files import repository_address

SUBMISSION = "task_id string, repo_url string, created_at string"


def submissions(spark: SparkSession, folder: str, files_a_batch: int = 5) -> DataFrame:
    """A stream of submissions with valid (an address that names a repository), owner and repo."""
    raw = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return raw.withColumn("_a", repository_address("repo_url")).select("*", F.col("_a").isNotNull().alias("valid"), "_a.owner", "_a.repo").drop("_a")


def run_queue(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, then stop. A restart goes on after the last batch that ended."""

    def batch(df: DataFrame, number: int) -> None:
        process(df.orderBy("created_at", "task_id"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_events(started: DataFrame, stages: dict[str, int]) -> DataFrame:
    """The events (task_id, seq, stage, progress) of tasks that go through all stages in order."""
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).alias("stage"), F.lit(p).alias("progress")) for i, (s, p) in enumerate(stages.items())])
    return started.select("task_id", F.explode(rows).alias("x")).select("task_id", "x.*")
