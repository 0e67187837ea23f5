"""A replayed stream ends in the state of the batch fold."""

import pytest
from pyspark.sql import functions as F

from studyloom.operators import state
from studyloom.streaming import answers


@pytest.mark.parametrize("expire", [None, 3_600_000])
def test_sm2_stream_equals_batch(spark, tmp_path, expire):
    rows = [(u, float(86400 * d), (u + d) % 6, d) for u in range(5) for d in range(8)]
    schema = "user_id long, ts double, quality int, seq long"
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[3] // 4 == k], schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "true")
    stream = answers.sm2_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src), expire_ms=expire)
    got = []
    q = stream.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(lambda df, i: got.extend(df.collect())).start()
    q.awaitTermination(120)
    last = {}
    for r in got:
        if r["user_id"] not in last or r["reviews"] >= last[r["user_id"]]["reviews"]:
            last[r["user_id"]] = r
    want = {r["user_id"]: r for r in state.sm2_fold(spark.createDataFrame(rows, schema), "user_id").collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}


def test_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert answers.visits(events).count() == 2
    assert answers.request_counts(events).agg(F.max("n")).first()[0] == 2
