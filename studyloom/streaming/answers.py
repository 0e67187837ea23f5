"""Structured Streaming: keyed state and windows over streams of answers.

The state steps are those of the batch folds, so a replayed stream ends in the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.operators import state


def request_counts(events: DataFrame, late: str = "1 hour", length: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """Requests of each user in sliding windows; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "user_id").agg(F.count("*").alias("n"))


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def sm2_stream(answers: DataFrame, key: str = "user_id", expire_ms: int | None = None) -> DataFrame:
    """SM-2 state of each key (ts in seconds, quality, seq), one row for each batch that changes it.

    A batch's rows of a key are sorted by (ts, seq), which takes three numbers for each of
    them; rows of later batches come after them, as the batch fold takes a list in its
    order. expire_ms: the state of a key without rows for so long goes, and a later row
    begins anew; otherwise state is kept for good.
    """
    kind = answers.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        s = state.sm2_start()
        if held.exists:
            reps, interval, ease, due, last, reviews = held.get
            s = {"reps": reps, "interval": interval, "ease": ease, "due": due, "last": last, "reviews": reviews}
        ts, quality, seq = (np.concatenate(x) for x in zip(*((f["ts"].to_numpy(), f["quality"].to_numpy(), f["seq"].to_numpy()) for f in frames)))
        for i in np.lexsort((seq, ts)).tolist():
            s = state.sm2_step(s, float(ts[i]), int(quality[i]))
        held.update((s["reps"], s["interval"], s["ease"], s["due"], s["last"], s["reviews"]))
        if expire_ms:
            held.setTimeoutDuration(expire_ms)
        yield pd.DataFrame([(keys[0], s["reviews"], s["reps"], s["interval"], round(s["ease"], 6), s["due"])], columns=[key, "reviews", "reps", "interval", "ease", "due"])

    return answers.select(key, "ts", "quality", "seq").groupBy(key).applyInPandasWithState(
        update,
        f"{key} {kind}, reviews long, reps long, interval double, ease double, due double",
        "reps long, interval double, ease double, due double, last double, reviews long",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout,
    )
