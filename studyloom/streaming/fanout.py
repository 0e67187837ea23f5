"""One answer, several states: signals, review items, facets, promotions, connections, mastery.

Each state is a function of its table before and of new answers, so a batch of everything
and a stream in small batches go through the same code. A stream keeps a version of each
table for every micro-batch, in the folder of the sink: batch n reads the newest version
before n and writes version n whole, so a batch that runs twice, in part or wholly, leaves
what it left the first time. Calibration rows are added under their batch's number.

Answers have: answer (unique), ts (seconds), doc, block, concepts (array), kind (test or
socratic), correct, first_try, hint, skipped, text. Answers of a key are taken by (ts,
answer) within a batch and behind those of earlier batches; signals and promotions go by
time alone, so late answers find their place there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from studyloom.functions import outcomes as O
from studyloom.operators import state

ANSWERS = "answer long, ts double, doc long, block string, concepts array<long>, kind string, correct boolean, first_try boolean, hint boolean, skipped boolean, text string"
#: Quality of an answered tutor question; what a joint answer adds to a connection, and its most.
SOCRATIC_QUALITY, REINFORCED, HEAVIEST = 4, 0.15, 1.0
_SM2 = "reviews long, reps long, interval double, ease double, due double, last double"
TABLES = {
    "signals": "doc long, concept long, wrong long, correct long, last_ts double, last_answer long, last_result string",
    "items": f"item string, {_SM2}",
    "facets": f"item string, {_SM2}",
    "promotions": "concept long, deep long, green_since double",
    "connections": "src long, dst long, weight double, reinforced long, last_ts double",
    "mastery": "concept long, mastery double, last_ts double, observations long",
}
CALIBRATION = "answer long, concept long, before double, after double, quality int"


def _no(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def with_quality(answers: DataFrame) -> DataFrame:
    """answers with quality, facet and concepts as a set without nulls; those without a document or an id aren't answers."""
    first = F.coalesce("first_try", F.lit(True))
    quality = F.when(F.col("kind") == "socratic", SOCRATIC_QUALITY).otherwise(O.mcq_quality(_no("correct"), first, _no("hint"), _no("skipped")))
    facet = F.when(F.col("kind") == "socratic", "synthesis").otherwise("recognition")
    kept = answers.where("answer is not null and doc is not null and ts is not null and kind in ('test', 'socratic')")
    concepts = F.array_distinct(F.filter(F.coalesce("concepts", F.array().cast("array<long>")), lambda x: x.isNotNull()))
    return kept.withColumns({"quality": quality.cast("int"), "facet": facet, "concepts": concepts})


def signals(before: DataFrame, answers: DataFrame) -> DataFrame:
    """Wrong and correct test answers of each concept, and the result of the last one by time."""
    a = answers.where((F.col("kind") == "test") & ~_no("skipped")).select("doc", F.explode("concepts").alias("concept"), "ts", "answer", _no("correct").alias("ok"))
    new = a.select("doc", "concept", (~F.col("ok")).cast("long").alias("wrong"), F.col("ok").cast("long").alias("correct"), F.col("ts").alias("last_ts"), F.col("answer").alias("last_answer"), F.when(F.col("ok"), "correct").otherwise("wrong").alias("last_result"))
    last = F.max(F.struct("last_ts", "last_answer", "last_result")).alias("last")
    g = before.unionByName(new).groupBy("doc", "concept").agg(F.sum("wrong").alias("wrong"), F.sum("correct").alias("correct"), last)
    return g.select("doc", "concept", "wrong", "correct", "last.last_ts", "last.last_answer", "last.last_result")


def _resumed_sm2(before: DataFrame, rows: DataFrame) -> DataFrame:
    """SM-2 states of items after new rows (item, ts, answer, quality); a key's state comes before its rows."""
    kinds = [c.split() for c in _SM2.split(", ")]
    old = before.select("item", F.lit(0).alias("new"), F.lit(None).cast("double").alias("ts"), F.lit(None).cast("long").alias("answer"), F.lit(0).alias("quality"), *(c for c, _ in kinds))
    new = rows.select("item", F.lit(1).alias("new"), "ts", "answer", "quality", *(F.lit(None).cast(k).alias(c) for c, k in kinds))
    value = lambda x: None if pd.isna(x) else x

    def step(s: dict, r: tuple) -> dict:
        if r[1]:
            return state.sm2_step(s, float(r[2]), int(r[4]))
        return {"reviews": int(r[5]), "reps": int(r[6]), "interval": float(r[7]), "ease": float(r[8]), "due": value(r[9]), "last": value(r[10])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from state.stream_groups(batches, state.sm2_start, step, lambda k, s: (k, *(s[c] for c, _ in kinds)), ["item", *(c for c, _ in kinds)])

    return old.unionByName(new).repartition("item").sortWithinPartitions("item", "new", "ts", "answer").mapInPandas(run, f"item string, {_SM2}")


def items(before: DataFrame, answers: DataFrame) -> DataFrame:
    """The schedule of each block, and of each of its tutor questions."""
    name = F.concat_ws(":", F.col("doc").cast("string"), "block", F.when(F.col("kind") == "socratic", "socratic"))
    return _resumed_sm2(before, answers.select(name.alias("item"), "ts", "answer", "quality"))


def facets(before: DataFrame, answers: DataFrame) -> DataFrame:
    """The schedule of each concept's facets."""
    a = answers.select(F.explode("concepts").alias("concept"), "facet", "ts", "answer", "quality")
    return _resumed_sm2(before, a.select(F.concat_ws(":", F.col("concept").cast("string"), "facet").alias("item"), "ts", "answer", "quality"))


def promotions(before: DataFrame, answers: DataFrame) -> DataFrame:
    """How often each concept was answered in depth, and since when it is green."""
    deep = O.is_deep(F.col("facet"), F.col("quality")) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    new = answers.select(F.explode("concepts").alias("concept"), deep.cast("long").alias("deep"), F.when(deep, F.col("ts")).alias("green_since"))
    return before.unionByName(new).groupBy("concept").agg(F.sum("deep").alias("deep"), F.min("green_since").alias("green_since"))


def connections(before: DataFrame, answers: DataFrame) -> DataFrame:
    """Connections of which one good answer has both ends get heavier.

    A connection looks for its other end in the answer's concepts; pairs of concepts are never made.
    """
    good = answers.where(F.when(F.col("kind") == "socratic", F.col("quality") >= 4).otherwise(_no("correct"))).where(F.size("concepts") >= 2)
    met = before.select("src", "dst").join(good.select("ts", "concepts", F.explode("concepts").alias("src")), "src").where(F.array_contains("concepts", F.col("dst")))
    added = met.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("ts").alias("at"))
    n = F.coalesce("n", F.lit(0))
    j = before.join(added, ["src", "dst"], "left")
    return j.select("src", "dst", F.when(n > 0, F.least(F.lit(HEAVIEST), F.col("weight") + REINFORCED * n)).otherwise(F.col("weight")).alias("weight"), (F.col("reinforced") + n).alias("reinforced"), F.greatest("last_ts", "at").alias("last_ts"))


def observations(before: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each concept of each answer: mastery before and after it."""
    a = answers.select(F.explode("concepts").alias("concept"), "ts", "answer", "quality", O.review_signal(F.col("quality")).alias("signal"))
    old = before.select("concept", F.lit(0).alias("new"), F.col("last_ts").alias("ts"), F.lit(None).cast("long").alias("answer"), F.lit(0).alias("quality"), F.col("mastery").alias("signal"), "observations")
    both = old.unionByName(a.select("concept", F.lit(1).alias("new"), "ts", "answer", "quality", "signal", F.lit(0).cast("long").alias("observations")))
    names = ["concept", "ts", "answer", "quality", "before", "after", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m, n = None, (0.0, None), 0
        for batch in batches:
            out = []
            for concept, new, ts, answer, quality, signal, seen in zip(*(batch[c].array for c in batch.columns)):
                if concept != now:
                    now, m, n = concept, (0.0, None), 0
                if not new:
                    m, n = (float(signal), float(ts)), int(seen)
                    continue
                was, m, n = m[0], state.mastery_step(m, float(ts), float(signal)), n + 1
                out.append((concept, ts, answer, quality, was, m[0], n))
            yield pd.DataFrame(out, columns=names)

    return both.repartition("concept").sortWithinPartitions("concept", "new", "ts", "answer").mapInPandas(run, "concept long, ts double, answer long, quality int, before double, after double, n long")


def mastery(before: DataFrame, seen: DataFrame) -> DataFrame:
    """The last state of each concept, given the observations of the new answers."""
    last = seen.select("concept", F.col("after").alias("mastery"), F.col("ts").alias("last_ts"), F.col("n").alias("observations"))
    return before.unionByName(last).groupBy("concept").agg(F.max_by(F.struct("mastery", "last_ts", "observations"), "observations").alias("x")).select("concept", "x.*")


STEPS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"signals": signals, "items": items, "facets": facets, "promotions": promotions, "connections": connections}


def fan_out(before: dict[str, DataFrame], answers: DataFrame) -> dict[str, DataFrame]:
    """All tables after new answers, and `calibration`, the rows that the answers add to it."""
    a = with_quality(answers)
    out = {name: step(before[name], a) for name, step in STEPS.items()}
    seen = observations(before["mastery"], a)
    return out | {"mastery": mastery(before["mastery"], seen), "calibration": seen.select("answer", "concept", "before", "after", "quality")}


def empty_tables(spark: SparkSession, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables before any answer; known: connections src, dst, weight."""
    tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    if known is not None:
        tables["connections"] = known.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"), F.lit(0).cast("long").alias("reinforced"), F.lit(None).cast("double").alias("last_ts"))
    return tables


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The whole versions of a table, by batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")) or []
    paths = [str(x.getPath().getParent().toString()) for x in found]
    return {int(p.rpartition("=")[2]): p for p in paths}


def table_after(spark: SparkSession, folder: str, name: str, batch: int | None = None) -> DataFrame | None:
    """The newest version of a table, or the newest before a batch; None if there is none."""
    found = {k: p for k, p in _versions(spark, f"{folder}/{name}").items() if batch is None or k < batch}
    return spark.read.schema(TABLES[name]).parquet(found[max(found)]) if found else None


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """The calibration rows of all batches."""
    found = list(_versions(spark, f"{folder}/calibration").values())
    return spark.read.schema(CALIBRATION).parquet(*found) if found else spark.createDataFrame([], CALIBRATION)


def apply_batch(answers: DataFrame, batch: int, folder: str, known: DataFrame | None = None) -> None:
    """Write version `batch` of every table; versions older than the one it was made from go."""
    spark = answers.sparkSession
    start = empty_tables(spark, known)
    before = {name: start[name] if (t := table_after(spark, folder, name, batch)) is None else t for name in TABLES}
    for name, df in fan_out(before, answers).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch:012d}")
    for name in TABLES:
        for _, path in sorted(_versions(spark, f"{folder}/{name}").items())[:-2]:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def fan_out_stream(answers: DataFrame, folder: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Keep the tables in folder up to date with a stream of answers; folder and checkpoint are shared by all executors."""
    stream = answers.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(lambda df, i: apply_batch(df, i, folder, known)).start()
