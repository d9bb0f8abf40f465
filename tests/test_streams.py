"""Stateful streams against their batch forms: out of order, over several triggers, and after a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import quota
from lexloom.sources import files
from lexloom.streaming import machines, twins


START = 1_000_000_000  # Spark takes a row at the epoch itself for a late one


def land(spark, folder, rows, schema, part):
    """One more file in a landing folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={part}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_sends_over_a_restart(spark, places):
    folder, out, checkpoint = places
    rng = random.Random(3)
    rows = sorted((rng.choice([0, 0, 0, 1, 2]), i, float(rng.randrange(4000))) for i in range(300))
    rows += [(7, 1000, 0.0), (7, 1001, 59.5), (7, 1002, 60.0), (7, 1003, 960.0)]
    schema = "user long, request long, sec double"

    def run():
        s = source(spark, folder, schema).withColumn("at", F.timestamp_seconds(F.col("sec") + START))
        machines.drain(machines.otp_sends(s, "user", "request", "at"), out, checkpoint)

    land(spark, folder, [r for r in rows if r[2] < 1500], schema, 1)
    run()
    land(spark, folder, [r for r in rows if 1500 <= r[2] < 2000], schema, 2)
    land(spark, folder, [r for r in rows if r[2] >= 2000], schema, 3)
    run()
    want = quota.otp_sends(spark.createDataFrame(rows, schema), "user", "request", "sec")
    got = machines.committed(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("user", "request", "sent", "retry_after_s").collect()))
    assert got.filter("user = 7").count() == 4


def test_verdicts_over_a_restart(spark, places):
    folder, out, checkpoint = places
    rng = random.Random(4)
    rows = [(rng.randrange(20), i, float(rng.randrange(0, 700)), rng.random() < 0.15) for i in range(200)]
    rows += [(50, 1000, 599.0, False), (50, 1001, 600.0, True), (50, 1002, 601.0, True)]
    schema = "code long, try long, sec double, ok boolean"

    def run():
        s = source(spark, folder, schema).withColumn("at", F.timestamp_seconds(F.col("sec") + START)).withColumn("issued", F.timestamp_seconds(F.lit(START)))
        machines.drain(machines.otp_verify(s, "code", "try", "at", "ok", "issued"), out, checkpoint)

    land(spark, folder, [r for r in rows if r[2] < 300], schema, 1)
    run()
    land(spark, folder, [r for r in rows if r[2] >= 300], schema, 2)
    run()
    want = quota.otp_verify(spark.createDataFrame(rows, schema).withColumn("issued", F.lit(0.0)), "code", "try", "sec", "ok", "issued")
    got = sorted(map(tuple, machines.committed(spark, out).collect()))
    assert got == sorted(map(tuple, want.collect()))
    assert [v for c, _, v in got if c == 50] == ["wrong", "expired", "cleared"]


def test_sessions_out_of_order(spark, places):
    folder, out, checkpoint = places
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(200_000)) for _ in range(150)]
    rows += [(9, 0), (9, 3000), (9, 1500), (9, 4800), (10, 0), (10, 1800), (10, 0)]
    schema = "user long, sec long"
    for part in range(3):
        land(spark, folder, rows[part::3], schema, part)
    s = source(spark, folder, schema).withColumn("at", F.timestamp_seconds(F.col("sec") + START))
    machines.drain(machines.sessions(s, "user", "at", late="10 days"), out, checkpoint)
    got = twins.latest(spark, out, "key", "start_us").filter("n > 0").select("key", F.expr(f"start_us div 1000000 - {START}"), "n")
    want = []
    for user, sec in sorted(rows):
        if want and want[-1][0] == user and sec - last < 1800:
            want[-1] = (user, want[-1][1], want[-1][2] + 1)
        else:
            want.append((user, sec, 1))
        last = sec
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_state_ends_with_the_watermark(spark, places):
    """A far later event moves the watermark; the state of idle keys is gone and later rows are judged as by the batch form."""
    folder, out, checkpoint = places
    schema = "user long, request long, sec double"
    rows = [(1, 1, 0.0), (1, 2, 10.0), (2, 3, 100_000.0), (1, 4, 200_000.0), (1, 5, 200_030.0)]
    for part, r in enumerate(rows[:3] + [None]):
        land(spark, folder, [r] if r else rows[3:], schema, part)
        s = source(spark, folder, schema).withColumn("at", F.timestamp_seconds(F.col("sec") + START))
        machines.drain(machines.otp_sends(s, "user", "request", "at", late="1 minute"), out, checkpoint)
    want = quota.otp_sends(spark.createDataFrame(rows, schema), "user", "request", "sec")
    assert sorted(map(tuple, machines.committed(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    sink = machines.once(path)
    batch = spark.range(5).withColumnRenamed("id", "event")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.select((F.col("event") + 5).alias("event")), 1)
    os.remove(f"{path}/batch=1/_SUCCESS")  # as a writer that died before its commit leaves it
    sink(batch.select((F.col("event") + 5).alias("event")), 1)
    assert sorted(r[0] for r in machines.committed(spark, path).collect()) == list(range(10))


def pdf(*pages):
    return b"%PDF-1.4\n" + b"\n".join(b"stream\n(" + p.encode() + b") Tj\nendstream" for p in pages)


def test_landing_folder(spark, places):
    """Large files in ranges, each file once over two triggers and a restart, failures with their status."""
    folder, out, checkpoint = places

    def run():
        machines.drain(files.landing_pages(spark, folder, part_bytes=200, files_per_trigger=2), out, checkpoint, "append")

    def write(**named):
        rows = [(f"{name}.{'docx' if name == 'broken' else 'pdf'}", content) for name, content in named.items()]
        assert files.write_files(spark.createDataFrame(rows, "name string, content binary"), folder) == len(rows)

    long = [f"page {k} " + "x" * 40 for k in range(50)]
    write(a=pdf("one", "two"), long=pdf(*long), odd=b"not a document", broken=b"PK\x03\x04 no archive")
    run()
    write(b=pdf("three"))
    run()
    run()
    got = sorted((os.path.basename(r.path), r.page_number, r.text, r.status) for r in machines.committed(spark, out).collect())
    want = [("a.pdf", 1, "one", "ok"), ("a.pdf", 2, "two", "ok"), ("b.pdf", 1, "three", "ok"), ("broken.docx", 1, "", "failed: BadZipFile"), ("odd.pdf", 1, "", "unsupported")]
    assert got == sorted(want + [("long.pdf", k + 1, t, "ok") for k, t in enumerate(long)])
    sizes = spark.read.format("binaryFile").load(folder).select("path", "length")
    assert files.page_ranges(sizes, 200).filter("path LIKE '%long.pdf'").count() > 10
