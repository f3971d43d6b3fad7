"""What must not grow with the tables: rows of a circle of includes, and rows, texts and partitions that one task holds."""

from pyspark.sql import functions as F

from quaylight.operators import docs


def test_circles_of_includes_are_walked_once(spark):
    """Nine levels of five circles of three are more rows than the limit of a recursive query allows here."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        edges = [(f"r{i}", f"{k}.txt", f"{(k + 1) % 3}.txt") for i in range(5) for k in range(3)]
        roots = spark.createDataFrame([(f"r{i}", "0.txt") for i in range(5)], "repo_id string, file_path string")
        got = docs.included(roots, spark.createDataFrame(edges, "repo_id string, _from string, _to string")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(tuple(r) for r in got) == sorted((f"r{i}", f"{k}.txt") for i in range(5) for k in range(3))


def test_includes_end_at_their_depth(spark):
    chain = spark.createDataFrame([("r", str(k), str(k + 1)) for k in range(12)], "repo_id string, _from string, _to string")
    got = docs.included(spark.createDataFrame([("r", "0")], "repo_id string, file_path string"), chain).collect()
    assert sorted(int(r["file_path"]) for r in got) == list(range(9))


def test_joins_that_grow_are_not_broadcast(spark):
    """Small tables, which Spark would broadcast by itself: tables of a row a file reach that size compressed and are many times it in the driver."""
    from quaylight.operators import lexer, security

    files = spark.createDataFrame([("r", "src/a.js", "app.get('/x', f)\n")], "repo_id string, file_path string, content string")
    plan = security.scan(lexer.lex(files), security.config_lines(files))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_planted_repositories_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from quaylight.plans import planted

    monkeypatch.setattr(planted, "KEYS_A_TASK", 10, raising=False)
    spark.range(205).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = planted.repositories(spark, str(tmp_path))
    assert made.select(F.spark_partition_id()).distinct().count() == 21
    assert made.select("repo_id").distinct().count() == 205


def test_a_stored_body_is_parsed_once_a_row(spark):
    """Between the parse and the tests that read it stands a step that Spark doesn't merge with them."""
    from quaylight.operators import stored

    rows = spark.createDataFrame([(1, '{"score": '), (2, "[1]"), (3, None)], "task_id long, body string")
    made = stored.rejected(stored.checked_assessments(rows))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    assert sorted((r["task_id"], r["reason"]) for r in made.collect()) == [(1, "not_json"), (2, "not_an_object"), (3, "not_json")]


def test_many_small_repositories_are_shuffled_in_small_parts(spark, tmp_path):
    """What the session had is put back, as other tests share it."""
    from quaylight.plans import planted

    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    was = [spark.conf.get(n) for n in names]
    spark.range(3).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    try:
        for given, kept in (("64m", [str(4 << 20), str(32 << 20)]), ("2m", ["2m", "2m"])):
            for n in names:
                spark.conf.set(n, given)
            planted.repositories(spark, str(tmp_path))
            assert [spark.conf.get(n) for n in names] == kept
    finally:
        for n, x in zip(names, was):
            spark.conf.set(n, x)


def test_a_search_for_other_line_ends_stands_once(spark):
    """Written into each other, they were searched for eight times over each text, whatever rules were chosen."""
    from quaylight.operators import whole

    files = spark.createDataFrame([("r", "a.py", "x = 1\n", 6)], "repo_id string, file_path string, content string, length long")
    plan = whole.walk(files, ["I"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(content") == 9


def test_lines_are_lexed_for_the_chosen_rules(spark):
    from quaylight.operators import whole

    rows = [("r", "a.py", "import os\nx = os.getenv('A')\nprint(1)\n", 40), ("r", "b.py", "# TODO\n", 7)]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, content string, length long")
    got = {tuple(rules): sorted((r["file_path"], r["line_no"]) for r in whole.relevant_lines(files, rules).collect()) for rules in (["D"], ["I"], ["I", "D"])}
    assert got == {("D",): [("a.py", 2)], ("I",): [("a.py", 3), ("b.py", 1)], ("I", "D"): [("a.py", 2), ("a.py", 3), ("b.py", 1)]}
