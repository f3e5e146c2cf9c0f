"""The keyed stream of bursts gives the batch form's rows, out of order within the watermark, with state by path."""

import random

from pyspark.sql import functions as F

from docspark.operators import incremental
from docspark.streaming.events import _Bursts, _folded, coalesce_events_folded

SCHEMA = "root_id string, event_type string, path string, ms long, event_id long"


def test_stream_equals_batch(spark, tmp_path):
    r, rows, t = random.Random(8), [], 1_700_000_000_000
    for i in range(300):
        t += r.choice([0, 5, 700, 1999, 2000, 2400, 9000])
        rows.append((r.choice(["a", "b"]), r.choice(["created", "modified", "modified", "removed", "renamed"]), f"p{r.randrange(4)}", t, i))
    rows += [("a", "modified", "end", t + 10**6, 900), ("b", "modified", "end", t + 10**6, 901)]
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).selectExpr("root_id", "event_type", "path", "timestamp_millis(ms) ts", "event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    df = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    want = incremental.coalesce_events(df).filter("path != 'end'")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = coalesce_events_folded(stream, "40 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(f"{tmp_path}/out")
    key = ["root_id", "path", "event_type", F.unix_micros("last_ts").alias("us")]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_state_is_a_row_a_path():
    one = (False, False, (5, 1, "created"), (5, 1, "created"))
    for i in range(1000):
        one = _folded(one, (False, False, (6 + i, i, "modified"), None))
    assert one == (False, False, (1005, 999, "modified"), (5, 1, "created"))
    assert _Bursts(2_000_000).gap == 2_000_000
