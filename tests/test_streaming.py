"""A store in a stream beside the batch: shuffled files, a stop in the middle, a failing batch, expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming import memory

SCHEMA = "key string, value string, tags array<string>, at timestamp, id long"


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", memory.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def writes(n=400):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(f"k{rng.randint(0, 30)}", f"v{i}", [rng.choice("abc"), f"t{i % 4}"] if i % 7 else None, start + timedelta(seconds=rng.randint(0, 200)), i) for i in range(n)]
    return rows + [(None, "x", [], start, n), ("k1", "no time", [], None, n + 1)]


def plain(rows):
    out = {}
    for key, value, tags, at, i in rows:
        if key is None or at is None:
            continue
        best, n, counts = out.get(key, (None, 0, {}))
        new = (at, i, value, tags or [])
        for t in set(tags or []):
            counts[t] = counts.get(t, 0) + 1
        out[key] = (max(best, new, key=lambda x: x[:2]) if best else new, n + 1, counts)
    return {k: (b[2], b[3], n, n > 1, c) for k, (b, n, c) in out.items()}


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stored(spark, path):
    return {r["key"]: (r["value"], r["tags"], r["versions"], r["overwrote"], r["tag_counts"]) for r in memory.current(spark, path).collect()}


def test_shuffled_files_and_a_restart(spark, tmp_path):
    rows = writes()
    random.Random(1).shuffle(rows)
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    for i in range(3):
        put(spark, rows[i::6], source, f"f{i}")
    memory.keep(memory.remember(stream(spark, source)), out, at).awaitTermination()
    assert stored(spark, out) == plain([r for i in range(3) for r in rows[i::6]])
    for i in range(3, 6):
        put(spark, rows[i::6], source, f"f{i}")
    memory.keep(memory.remember(stream(spark, source)), out, at).awaitTermination()
    assert stored(spark, out) == plain(rows)
    assert {r["key"] for r in memory.tagged(memory.current(spark, out), "a").collect()} == {k for k, v in plain(rows).items() if "a" in v[1]}


def test_a_batch_that_fails_is_run_again(spark, tmp_path):
    rows = writes(200)
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    for i in range(4):
        put(spark, rows[i::4], source, f"f{i}")

    def broken(batch, number):
        if number == 2:
            raise RuntimeError("a task is lost")
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    query = memory.remember(stream(spark, source)).writeStream.outputMode("update").foreachBatch(broken).option("checkpointLocation", at).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    memory.keep(memory.remember(stream(spark, source)), out, at).awaitTermination()
    assert stored(spark, out) == plain(rows)


def test_a_key_expires(spark, tmp_path):
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    t = datetime(2024, 1, 1)
    run = lambda: memory.keep(memory.remember(stream(spark, source), timedelta(minutes=10)), out, at).awaitTermination()
    put(spark, [("a", "1", ["x"], t, 1), ("b", "1", [], t, 2)], source, "f0")
    run()
    put(spark, [("b", "2", [], t + timedelta(minutes=8), 3)], source, "f1")
    run()
    assert set(stored(spark, out)) == {"a", "b"}
    put(spark, [("c", "1", [], t + timedelta(minutes=15), 4)], source, "f2")
    run()
    put(spark, [("c", "2", [], t + timedelta(minutes=15, seconds=1), 5)], source, "f3")
    run()
    got = stored(spark, out)
    assert set(got) == {"b", "c"} and got["b"][0] == "2" and got["c"][2] == 2
    put(spark, [("a", "again", [], t + timedelta(minutes=16), 6)], source, "f4")
    run()
    assert stored(spark, out)["a"] == ("again", [], 1, False, {})
