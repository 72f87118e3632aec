"""Run folders: first whole folder of a model, tolerant and strict lines, streams that go on, writers that leave nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.sources import runs


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    runs.register(spark)


def put(spark, rows, path, batch=0):
    df = spark.createDataFrame([(*r, None) for r in rows], runs.SCHEMA)
    df.repartition(2).write.format("runs").option("path", str(path)).option("batch", batch).mode("append").save()


def score(model, n, overall=1.0):
    return [(model, f"t{i}", "L0", overall, None if overall else "E10_format_error") for i in range(n)]


def read(spark, folders, **options):
    return spark.read.format("runs").options(folders=json.dumps([str(f) for f in folders]), **options).load()


def test_first_whole_folder(spark, tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    put(spark, score("x/y é", 5) + score("m", 3, 0.0), a)
    put(spark, score("x/y é", 5, 0.5) + score("m", 6, 0.25) + score("only", 2), b)
    put(spark, score("m", 9, 0.75), c)
    got = lambda **o: {(r.model, r.n, r.o) for r in read(spark, [a, b, c, tmp_path / "missing"], **o).groupBy("model").agg(F.count("*").alias("n"), F.avg("overall").alias("o")).collect()}
    assert got(least=5) == {("x/y é", 5, 1.0), ("m", 6, 0.25)}
    assert got() == {("x/y é", 5, 1.0), ("m", 3, 0.0), ("only", 2, 1.0)}
    assert got(least=7) == {("m", 9, 0.75)}
    r = read(spark, [a]).where("model = 'm'").first()
    assert (r.task_id[0], r.level, r.error_type, r.folder) == ("t", "L0", "E10_format_error", str(a))
    assert read(spark, [a, b, c]).rdd.getNumPartitions() == 3  # a model each


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "checkpoint_m.000000000-0a.jsonl").write_text('{"task_id": "a", "overall": 1}\n\n{broken\n5\n{"task_id": "b", "level": "L1"}\n')
    (tmp_path / "notes.jsonl").write_text("{}\n")
    assert sorted((r.task_id, r.overall) for r in read(spark, [tmp_path]).collect()) == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="line 3"):
        read(spark, [tmp_path], strict=True).collect()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(*r, None) for r in score("m", 40)], runs.SCHEMA).repartition(4)
    broken = df.withColumn("level", F.when(F.col("task_id") == "t7", F.raise_error(F.lit("lost"))).otherwise(F.col("level")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("runs").option("path", str(tmp_path / "out")).mode("append").save()
    left = [f for d, _, names in os.walk(tmp_path) for f in names if "_staged" not in d]
    assert left == [] and read(spark, [tmp_path / "out"]).count() == 0
    put(spark, score("m", 40), tmp_path / "out")
    assert read(spark, [tmp_path / "out"]).count() == 40


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        s = spark.readStream.format("runs").option("folders", json.dumps([str(folder)])).load().select("model", "task_id", "overall")
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.schema("model string, task_id string, overall double").parquet(out).collect()))

    put(spark, score("a", 3), folder, 1)
    assert run() == [("a", f"t{i}", 1.0) for i in range(3)]
    assert run() == [("a", f"t{i}", 1.0) for i in range(3)]
    put(spark, score("b", 2, 0.5), folder, 2)
    put(spark, score("a", 1, 0.0), folder, 3)
    assert run() == sorted([("a", f"t{i}", 1.0) for i in range(3)] + [("b", "t0", 0.5), ("b", "t1", 0.5), ("a", "t0", 0.0)])
