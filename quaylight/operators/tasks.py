"""Tasks as an event log: latest state, allowed changes, queue, expiry, history; and upserts of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V

#: Progress at which each stage begins. Fixed values.
STAGE_PROGRESS = {"downloading": 10, "scanning": 50, "assessing": 80, "repairing": 90, "analyzing": 95, "saving": 97, "finished": 100}


def latest_state(events: DataFrame) -> DataFrame:
    """One row for each task of events (task_id, ts, seq, status, progress): its last."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq")).alias("x"), F.min("ts").alias("created_at"))
    return last.select("task_id", "x.status", "x.progress", F.col("x.ts").alias("updated_at"), "created_at")


def allowed_changes(changes: DataFrame) -> DataFrame:
    """changes (task_id, status, next_status) with allowed: completed and failed are final."""
    t = F.broadcast(changes.sparkSession.createDataFrame(V.TRANSITIONS, "_a string, _b string"))
    return changes.join(t, (F.col("status") == F.col("_a")) & (F.col("next_status") == F.col("_b")), "left").withColumn("allowed", F.col("_a").isNotNull()).drop("_a", "_b")


def oldest_pending(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending'").orderBy("created_at", "task_id").limit(1)


def queue_state(tasks: DataFrame) -> DataFrame:
    """One row: pending, running, and whether the queue is full."""
    return tasks.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running")).withColumn("is_full", F.col("pending") >= V.MAX_PENDING)


def fail_unfinished(tasks: DataFrame, message: str) -> DataFrame:
    """After a restart: pending and running tasks have failed."""
    stale = F.col("status").isin("pending", "running")
    return tasks.withColumn("error_message", F.when(stale, message).otherwise(F.col("error_message"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks completed (text, ISO) longer ago than their time to live; what isn't a time never expires."""
    return tasks.where(F.try_to_timestamp("completed_at") < now - F.expr(f"INTERVAL {V.TASK_TTL_HOURS} HOURS"))


def without_expired(table: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """A table's rows but for those of expired tasks."""
    return table.join(expired(tasks, now).select("task_id"), "task_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows of new replace those of old by task_id. created_at stays, updated_at is now; both tables have equal columns."""
    kept = old.join(new.select("task_id"), "task_id", "left_anti")
    first = old.select(F.col("task_id"), F.col("created_at").alias("_c"))
    fresh = new.join(first, "task_id", "left").withColumn("created_at", F.coalesce("_c", now)).withColumn("updated_at", now).drop("_c")
    return kept.unionByName(fresh.select(*old.columns))


def history(entries: DataFrame, size: int = V.HISTORY_SIZE) -> DataFrame:
    """The last entry of each task, newest first, at most `size`."""
    n = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("seq")))
    return entries.withColumn("_n", n).where("_n = 1").drop("_n").orderBy(F.desc("created_at"), "task_id").limit(size)
