"""Answer progress as a stream equals its batch form; inbox rows come once."""

import random
import time

from pyspark.sql import functions as F

from docspark.streaming import progress

SCHEMA = "operation_id string, arrival long, sequence long, event_type string, node_id string, duration_ms long, delta string, status string"


def events():
    r, rows = random.Random(4), []
    for op in ("a", "b", "c"):
        seq = 0
        for _ in range(60):
            seq += r.choice([1, 1, 2, -3])
            kind = r.choice(["node_started", "node_started", "node_progress", "node_completed", "node_failed", "node_skipped", "answer_delta", "answer_delta", "ask_completed", "ask_started"])
            rows.append((op, len(rows), seq, kind, f"n{r.randrange(4)}" if kind.startswith("node") else None, r.choice([None, 5, 70]), "x" + str(len(rows)), r.choice([None, "failed"])))
    return rows


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), SCHEMA)
    want = sorted(tuple(r) for r in progress.ask_progress(df).collect())
    for i in range(3):
        df.filter(F.col("arrival") % 60 < 20 * (i + 1)).filter(F.col("arrival") % 60 >= 20 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.operation_id] = tuple(r)

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # One file at a time, in the order of arrival.
    names = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = progress.ask_progress_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(keep).start()
    for _ in range(300):  # the timeout makes empty batches go on, so the stream is never idle
        if sum(p.numInputRows > 0 for p in run.recentProgress) >= 3:
            break
        time.sleep(0.2)
    run.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert any(r[7] for r in want)
    assert len(names) == 3 and sorted(seen.values()) == want


def test_inbox(spark):
    rows = [(1, "renamed", 1), (1, "renamed", 1), (1, "modified", 2), (2, "renamed", None), (2, "renamed", None)]
    df = spark.createDataFrame(rows, "file_id long, event_type string, revision_id long").withColumn("detected_at", F.lit("2024-01-01").cast("timestamp"))
    assert progress.inbox_stream(df).count() == 3
