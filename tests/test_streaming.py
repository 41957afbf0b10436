"""First events of keys, marks and landing against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tidewire.streaming import first_seen, landing, marks

EVENTS = "key string, ts timestamp, n int, t int"
DAY = datetime(2026, 1, 1)


def chain(rows, hours=24):
    """The accepted n, a key's events in order of time."""
    last, kept = {}, []
    for key, ts, n, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or ts > last[key] + timedelta(hours=hours):
            last[key] = ts
            kept.append(n)
    return sorted(kept + [r[2] for r in rows if r[0] is None or r[1] is None])


def events(seed):
    r = random.Random(seed)
    rows = [(r.choice("aaab"), DAY + timedelta(minutes=r.randrange(60 * 24 * 40)), i, 0) for i in range(600)]
    rows += [("hot", DAY + timedelta(seconds=r.randrange(3600)), 1000 + i, 0) for i in range(200)]
    rows += [("m", DAY.replace(hour=23, minute=50), 2000, 0), ("m", DAY + timedelta(days=1, minutes=10), 2001, 0), ("m", DAY.replace(hour=23, minute=50) + timedelta(hours=24), 2002, 0), ("m", DAY.replace(hour=23, minute=50) + timedelta(hours=24, microseconds=1), 2003, 0)]
    return [*rows, (None, DAY, 3000, 0), (None, DAY, 3001, 0), ("n", None, 3002, 0), ("n", None, 3003, 0)]


def test_first_per_key(spark):
    for rows in (events(1), events(2)):
        got = first_seen.first_per_key(spark.createDataFrame(rows, EVENTS), "key", "ts")
        assert sorted(r.n for r in got.collect()) == chain(rows)
        assert got.columns == ["key", "ts", "n", "t"]
    short = first_seen.first_per_key(spark.createDataFrame(rows, EVENTS), "key", "ts", hours=1)
    assert sorted(r.n for r in short.collect()) == chain(rows, 1)
    assert first_seen.first_per_key(spark.createDataFrame([], EVENTS), "key", "ts").count() == 0


def test_first_per_key_stream(spark, tmp_path):
    """The batch and the stream keep the same, also over a restart between micro-batches."""
    rows = sorted(events(3), key=lambda r: r[1] or DAY)
    df, mark = spark.createDataFrame(rows, EVENTS), str(tmp_path / "mark")
    box = str(tmp_path / "in")
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(half, EVENTS).coalesce(1).write.mode("append").parquet(box)
        live = first_seen.first_per_key(spark.readStream.schema(df.schema).parquet(box), "key", "ts")
        live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == chain(rows)


def test_first_per_key_stream_in_small_batches(spark, tmp_path):
    """A micro-batch whose keys are cut into several Arrow batches, out of order and with ties, keeps what the batch keeps."""
    rows = [r for r in events(4) if r[0] is not None and r[1] is not None]
    rows += [("tie", DAY, n, 0) for n in (5001, 5000, 5002)]
    random.Random(4).shuffle(rows)
    df, size = spark.createDataFrame(rows, EVENTS), "spark.sql.execution.arrow.maxRecordsPerBatch"
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        live = first_seen.first_per_key(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "ts")
        live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(size, before)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == chain(rows)


@pytest.mark.parametrize("fails", ["before the marks", "after the marks"])
def test_consumed_once(spark, tmp_path, fails):
    """A batch that dies on either side of its marks is run again, handles the same rows and marks them once."""
    box, ledger, out = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "out")
    rows = spark.createDataFrame([(f"i{n}", n == 3) for n in range(8)] + [("i1", False), (None, False)], "id string, processed boolean")
    rows.coalesce(1).write.parquet(box)
    runs = []

    def handle(df, batch):
        runs.append(batch)
        df.select("id").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if len(runs) == 1:
            if fails == "after the marks":
                marks.mark(df, ledger, batch)
            raise RuntimeError("lost")

    consume = lambda: marks.consume(marks.stream_inbox(spark, box, rows.schema), ledger, str(tmp_path / "c"), handle)
    with pytest.raises(Exception, match="lost"):
        consume().awaitTermination()
    consume().awaitTermination()
    rows.where("id in ('i1', 'i2')").unionByName(spark.createDataFrame([("new", None)], rows.schema)).coalesce(1).write.mode("append").parquet(box)
    consume().awaitTermination()
    done = sorted(r.id for r in spark.read.parquet(f"{out}/*").collect())
    assert done == sorted([f"i{n}" for n in range(8) if n != 3] + ["new"]) and runs[0] == runs[1] and len(set(runs)) == 2
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == done
    assert marks.unprocessed(rows, ledger).count() == 0


def test_landing_reads_the_shards_of_its_files(spark, tmp_path):
    table = str(tmp_path / "table")
    text = "{1:F01X}{2:I940X}{4:\n:20:%s\n-}"
    files = spark.createDataFrame([("broker:a", f"f{i}", bytearray("".join(text % f"{i}-{j}" for j in range(3)).encode())) for i in range(40)], "source_id string, name string, content binary")
    assert landing.land(landing.parsed(files), table) == {"landed": 120, "already": 0}
    again = landing.parsed(files.where("name in ('f1', 'f2')"))
    assert landing.land(again, table) == {"landed": 0, "already": 6}
    shards = [r[0] for r in again.select(landing._shard("file_sha256")).distinct().collect()]
    read = landing.landed(spark, table, shards)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert read.select(F.input_file_name()).distinct().count() < landing.landed(spark, table).select(F.input_file_name()).distinct().count()
    assert landing.landed(spark, table).select("message_id").distinct().count() == 120
