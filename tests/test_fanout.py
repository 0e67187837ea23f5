"""A stream of answers in small batches leaves what one batch of them all leaves; a batch that runs again changes nothing."""

import random

import pytest

from studyloom.streaming import fanout


def rows(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["test", "test", "socratic", "other"])
        concepts = rng.choice([[1, 2], [2, 3, None], [3, 3], [], None, [1, 2, 3, 4]])
        flag = lambda: rng.choice([True, False, None])
        out.append((i, 86400.0 * (i // 2) + rng.random(), rng.randrange(3), f"b{rng.randrange(3)}", concepts, kind, flag(), flag(), flag(), rng.random() < 0.1, rng.choice(["said", " ", None])))
    return out


def known(spark):
    return spark.createDataFrame([(1, 2, 0.3), (2, 3, 0.9), (4, 1, 0.5), (7, 8, 0.2)], "src long, dst long, weight double")


def shown(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark):
    answers = spark.createDataFrame([*rows(60), (None, 1.0, 1, "b", [1], "test", *[None] * 5), (99, None, 1, "b", [1], "test", *[None] * 5)], fanout.ANSWERS)
    return {name: shown(df) for name, df in fanout.fan_out(fanout.empty_tables(spark, known(spark)), answers).items()}


def test_stream_equals_batch(spark, whole, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k in range(3):
        spark.createDataFrame([r for r in rows(60) if r[0] // 20 == k], fanout.ANSWERS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(fanout.ANSWERS).option("maxFilesPerTrigger", 1).parquet(src)
    assert fanout.fan_out_stream(stream, out, ckpt, known(spark)).awaitTermination(300)
    got = {name: shown(fanout.table_after(spark, out, name)) for name in fanout.TABLES} | {"calibration": shown(fanout.calibration(spark, out))}
    assert got == whole


def test_batches_again(spark, whole, tmp_path):
    out = str(tmp_path)
    for k in (0, 1, 1, 2, 2):
        batch = spark.createDataFrame([r for r in rows(60) if r[0] // 20 == k], fanout.ANSWERS)
        if k == 1:  # a run that broke off after its first tables
            before = {n: fanout.table_after(spark, out, n, 1) for n in fanout.TABLES}
            fanout.fan_out(before, batch)["signals"].write.mode("overwrite").parquet(f"{out}/signals/batch={1:012d}")
        fanout.apply_batch(batch, k, out, known(spark))
    got = {name: shown(fanout.table_after(spark, out, name)) for name in fanout.TABLES} | {"calibration": shown(fanout.calibration(spark, out))}
    assert got == whole
    assert sorted(fanout._versions(spark, f"{out}/items")) == [1, 2]


def test_late_answers(spark):
    """Signals go by time: a late answer is counted, and doesn't become the last one."""
    start = fanout.empty_tables(spark)
    row = lambda i, ts, ok: (i, ts, 1, "b", [5], "test", ok, True, False, False, None)
    make = lambda *r: spark.createDataFrame(list(r), fanout.ANSWERS)
    first = fanout.fan_out(start, make(row(1, 100.0, True)))
    late = fanout.fan_out({n: first[n] for n in fanout.TABLES}, make(row(2, 50.0, False)))
    (s,) = late["signals"].collect()
    assert (s["wrong"], s["correct"], s["last_ts"], s["last_result"]) == (1, 1, 100.0, "correct")
    assert fanout.fan_out(start, make())["items"].collect() == []
