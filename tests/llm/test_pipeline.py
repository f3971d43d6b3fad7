import random

import time
from pathlib import Path

import corpus_pipeline
from tests.llm import cases

from quaylight.llm import common


def write(spark, folder, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    sentence = lambda: cases.text(rng, rng.randint(4, 15)).capitalize() + "."
    good = {i: "\n".join(sentence() for _ in range(rng.randint(3, 12))) for i in range(400)}
    toxic = {i: good[i - 1000] + " moron idiot moron scum." for i in range(1000, 1120)}
    shared = "\n".join(sentence() for _ in range(8))
    passage = {2000 + i: f"{sentence()}\n{shared}\n{sentence()}" for i in range(6)}
    extra = {3000: "SHOUT!! ME!! " * 30, 3001: "", 3002: good[7], 3003: good[8].replace("w1", "w2", 1)}
    rows = [*good.items(), *toxic.items(), *passage.items(), *extra.items(), (3004, None)]
    labels = [(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(1000, 1100)]
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda n: {r["doc_id"] for r in out[n].select("doc_id").collect()}
    assert not ids("quality") & {3000, 3001, 3004} and len(ids("quality") & good.keys()) >= 398
    assert not ids("toxicity") & toxic.keys() and len(ids("toxicity") & good.keys()) >= 395
    assert 3002 not in ids("near_duplicates") and len(ids("near_duplicates") & good.keys()) >= 393
    texts = {r["doc_id"]: r for r in out["line_dedup"].collect()}
    inner = shared.split("\n")[3]
    assert sum(inner in texts[i]["text"] for i in passage if i in texts) == 1
    assert all(len(r["text"]) == r["n_chars"] for r in texts.values())
    assert {r["doc_id"] for r in out["packing"].collect()} == ids("near_duplicates")
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, out["packing"].collect()))


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_a_write_shuffled_goes_with_it(spark):
    """Signatures of the corpus stayed on disk beside all that came after them, until the driver collected its garbage."""
    ids = lambda: {n for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split(" ") if (n := b).startswith("shuffle_")}
    before, setting = ids(), spark.conf.get(common._CLEANUP)
    saved = common.save(spark.range(5000).selectExpr("id % 700 as k", "id").groupBy("k").count().distinct())
    end = time.time() + 20
    while ids() - before and time.time() < end:
        time.sleep(0.2)
    assert not ids() - before and saved.count() == 700 and spark.conf.get(common._CLEANUP) == setting


def test_tables_of_stages_go(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "\n".join(cases.text(rng, 12).capitalize() + "." for _ in range(6))) for i in range(60)]
    write(spark, tmp_path, rows, [(i, 1, 0) for i in range(40)])
    made = []
    seen, folder = common.shared_dir, lambda s: made.append(seen(s)) or made[-1]
    common.shared_dir = folder
    try:
        out = corpus_pipeline.run(spark, str(tmp_path))
    finally:
        common.shared_dir = seen
    left = [p for p in made if Path(p.removeprefix("file://")).exists()]
    assert len(made) > 20 and len(left) == 1 and left[0] in out.inputFiles()[0] and out.count() >= 0
