import json

from quaylight.operators.tasks import STAGE_PROGRESS
from quaylight.streaming import queue


def test_queue_goes_on_after_a_restart(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()

    def put(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("task_id", "repo_url", "created_at"), r))) for r in rows))

    put("1.json", ("b", "https://github.com/o/r.git", "2"), ("a", "https://github.com/o/q", "1"), ("x", "http://github.com/o/q", "0"))
    for _ in range(2):
        queue.run_queue(queue.submissions(spark, str(inbox)), lambda df, n: seen.append([(r["task_id"], r["valid"], r["repo"]) for r in df.collect()]), str(tmp_path / "c")).awaitTermination(120)
        put("2.json", ("c", "https://github.com/settings/q", "3"))
    assert seen == [[("x", False, None), ("a", True, "q"), ("b", True, "r")], [("c", False, None)]]


def test_stage_events(spark):
    got = queue.stage_events(spark.createDataFrame([("a",)], "task_id string"), STAGE_PROGRESS).orderBy("seq").collect()
    assert [r["progress"] for r in got] == [10, 50, 80, 90, 95, 97, 100]


def test_task_states_survive_a_restart_and_end_in_event_time(spark, tmp_path):
    from quaylight.streaming import states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run(name, *rows):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("task_id", "ts", "status", "progress"), (i, f"2025-01-{ts}:00", s, p)))) for i, ts, s, p in rows))
        events = spark.readStream.schema(states.EVENT).json(str(inbox))
        states.changes(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["task_id"], r["ts"].strftime("%dT%H:%M"), r["status"], r["progress"], r["note"]) for r in got)

    first = run("1", ("a", "01T10:00", "running", 10), ("a", "01T09:00", "pending", 0), ("b", "01T10:00", "pending", 0), ("x", "01T10:00", "completed", 0))
    assert first == [("a", "01T09:00", "pending", 0, ""), ("a", "01T10:00", "running", 10, ""), ("b", "01T10:00", "pending", 0, ""), ("x", "01T10:00", None, 0, "refused")]
    # a new query goes on with the states of the one before; b hears of nobody until its deadline
    second = [r for r in run("2", ("a", "01T11:00", "running", 50), ("a", "01T11:30", "running", 20), ("a", "01T12:00", "completed", None), ("c", "01T17:00", "pending", 0)) if r not in first]
    assert second[:3] == [("a", "01T11:00", "running", 50, ""), ("a", "01T11:30", "running", 50, "refused"), ("a", "01T12:00", "completed", 100, "")]
    assert ("b", "01T16:00", "failed", 0, "stale") in second and second[-1] == ("c", "01T17:00", "pending", 0, "")
    third = [r for r in run("3", ("c", "01T18:00", "restarted", None), ("a", "01T18:00", "restarted", None), ("d", "04T13:00", "pending", 0)) if r not in first + second]
    assert ("c", "01T18:00", "failed", 0, "restarted") in third and ("a", "04T12:00", "completed", 100, "expired") in third
    assert not [r for r in third if r[0] == "a" and r[4] != "expired"]
    # an expired task is unknown again
    fourth = [r for r in run("4", ("a", "09T10:00", "running", 1), ("a", "09T11:00", "pending", 0)) if r not in first + second + third]
    assert [r for r in fourth if r[0] == "a"] == [("a", "09T10:00", None, 0, "refused"), ("a", "09T11:00", "pending", 0, "")]
    assert {r[0] for r in fourth if r[4] == "expired"} == {"b", "c"}
