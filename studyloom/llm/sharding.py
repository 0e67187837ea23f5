"""Sharding: a uniform shuffle with exact shard sizes from a communication matrix.

1. The rows of the input get the number of their source partition, once and for all (a
   written table). Source partitions are dealt into blocks.
2. A matrix says how many rows of each block go to each cell, a cell being a stretch of
   one shard's slots. It has the law that a uniform permutation of all rows would give it,
   the multivariate hypergeometric one: a block tree is halved level by level and every
   node draws how many rows of each cell its left half sends. Row and column sums are
   exact, so shard sizes differ by at most one.
3. Each block permutes its rows and deals them by its row of the matrix; after the exchange
   each cell permutes again. A row's slot is its cell's first slot plus its place there.

Everything is DataFrame functions; draws are inversions of the exact distribution with
hashed uniforms, so a run repeats for the same source partitions. No group is larger than
rows_per_cell, whatever values repeat: rows are dealt by place, never by key. The law is
`rows`; with exact row counts equal texts can't be kept in one shard.

Defined cases: null text has size 1 and the crc of an empty text; null or repeated ids and
repeated rows are dealt like any others; an empty table gives an empty result; carried
columns keep their names, and one that is called shard or slot is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.session import materialize

ROWS_PER_CELL = 1 << 20
LEAST_CELLS = 64
#: Levels of the matrix tree between two exchanges of its nodes.
SPREAD = 5


def _log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, then Stirling's series to 1e-13."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of `draws` balls are good, by inversion of the distribution.

    The values within 14 standard deviations of the mean are walked from below; what lies
    outside has less weight than a double can add.
    """

    def bounds(v: Column) -> Column:
        good, total, draws = v["good"], v["total"], v["draws"]
        safe = F.greatest(total, F.lit(1)).cast("double")
        mean = draws * good / safe
        sd = F.sqrt(mean * (1 - good / safe) * (total - draws) / F.greatest(total - 1, F.lit(1)))
        lo = F.greatest(F.lit(0), draws + good - total, F.floor(mean - 14 * sd - 14)).cast("long")
        hi = F.least(good, draws, F.ceil(mean + 14 * sd + 14)).cast("long")
        return F.struct(good.alias("good"), total.alias("total"), draws.alias("draws"), v["u"].alias("u"), lo.alias("lo"), hi.alias("hi"))

    def walk(v: Column) -> Column:
        good, total, draws, lo, lf = v["good"], v["total"], v["draws"], v["lo"], _log_factorial
        log_p = lf(good) - lf(lo) - lf(good - lo) + lf(total - good) - lf(draws - lo) - lf(total - good - draws + lo) - lf(total) + lf(draws) + lf(total - draws)

        def step(acc: Column, k: Column) -> Column:
            ratio = (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1)).cast("double")
            below = acc["cdf"] + acc["p"]
            more = F.struct((acc["p"] * ratio).alias("p"), below.alias("cdf"), (acc["n"] + F.when(below < v["u"], 1).otherwise(0)).alias("n"))
            return F.when(acc["cdf"] >= v["u"], acc).otherwise(more)  # found already

        start = F.struct(F.exp(log_p).alias("p"), F.lit(0.0).alias("cdf"), F.lit(0).alias("n"))
        ks = F.when(v["hi"] > lo, F.sequence(lo, v["hi"] - 1)).otherwise(F.array().cast("array<bigint>"))
        return lo + F.aggregate(ks, start, step, lambda acc: acc["n"])

    given = F.struct(good.cast("long").alias("good"), total.cast("long").alias("total"), draws.cast("long").alias("draws"), uniform.alias("u"))
    return _let(given, lambda v: _let(bounds(v), walk))


def _uniform(seed: int, *keys: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") / float(1 << 53)


def _left_draws(cells: Column, draws: Column, seed: int, node: Column) -> Column:
    """A multivariate hypergeometric draw: how many of `draws` rows fall into each cell."""
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)

    def step(acc: Column, at: Column) -> Column:
        got = hypergeometric(F.get(cells, at), acc["total"], acc["draws"], _uniform(seed, node, at))
        return _let(got, lambda g: F.struct(F.concat(acc["out"], F.array(g)).alias("out"), (acc["total"] - F.get(cells, at)).alias("total"), (acc["draws"] - g).alias("draws")))

    zero = F.struct(F.array().cast("array<bigint>").alias("out"), total.alias("total"), draws.alias("draws"))
    return F.aggregate(F.sequence(F.lit(0), F.size(cells) - 1), zero, step, lambda acc: acc["out"])


def communication_matrix(sizes: DataFrame, cells: DataFrame, n_blocks: int, seed: int) -> DataFrame:
    """(block, row): for every block how many of its rows go to each cell, as an array.

    sizes has (block, n); cells has one row with `caps`, the cells' sizes. n_blocks is a
    power of two. The one row that starts the tree holds n_blocks + number of cells longs,
    a few million-th parts of the rows. Each level doubles the rows; every SPREAD levels
    they are dealt out to all tasks, so but for the first levels no task draws many nodes.
    """
    every = sizes.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("m"))
    ns = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0).cast("long")))
    tree = every.select(ns.alias("ns")).crossJoin(F.broadcast(cells)).select(F.lit(0).alias("block"), "ns", F.col("caps").alias("row"))
    width, level = n_blocks, 0
    while width > 1:
        half, level = width // 2, level + 1
        left = F.aggregate(F.slice("ns", 1, half), F.lit(0).cast("long"), lambda a, x: a + x)
        tree = tree.withColumn("left", _left_draws(F.col("row"), left, seed, F.concat_ws("/", F.lit(str(width)), "block")))
        children = F.array(
            F.struct(F.col("block"), F.slice("ns", 1, half).alias("ns"), F.col("left").alias("row")),
            F.struct((F.col("block") + half).alias("block"), F.slice("ns", half + 1, half).alias("ns"), F.zip_with("row", "left", lambda a, b: a - b).alias("row")),
        )
        tree = tree.select(F.inline(children))
        if level % SPREAD == 0 and half > 1:
            tree = tree.repartition(min(1 << level, 2000), "block")
        width = half
    return tree.select("block", "row")


def shard(rows: DataFrame, n_shards: int = 8, seed: int = 20240229, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """rows with `shard` (0..n_shards-1) and `slot` (gapless from 0 in its shard), uniformly shuffled.

    The columns given travel through the two exchanges, so pass those that are wanted.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rows = rows.select(*(F.col(f"`{c}`") for c in names))
    plain = rows.toDF(*(f"c{i}" for i in range(len(names)))).withColumns({"src": F.spark_partition_id(), "rid": F.monotonically_increasing_id()})
    plain = materialize(plain, "shard-rows")
    total = plain.count()
    n = LEAST_CELLS
    while n * rows_per_cell < total:
        n *= 2
    per_shard = -(-n // n_shards)  # cells of a shard
    blocks = plain.withColumn("block", F.pmod(F.hash("src", F.shiftright("rid", 12)), F.lit(n)))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))

    spark = rows.sparkSession
    # cell k holds slots [first, first + cap) of its shard; shards and cells differ by one row at most
    bounds = spark.range(n_shards * per_shard).select((F.col("id") / per_shard).cast("int").alias("shard"), F.pmod("id", F.lit(per_shard)).alias("part"), "id")
    shard_rows = F.lit(total // n_shards) + (F.col("shard") < total % n_shards).cast("long")
    first = F.floor(shard_rows * F.col("part") / F.lit(per_shard))
    bounds = bounds.select("id", "shard", first.alias("first"), (F.floor(shard_rows * (F.col("part") + 1) / F.lit(per_shard)) - first).alias("cap"))
    caps = bounds.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "cap"))), lambda x: x["cap"]).alias("caps"))
    matrix = communication_matrix(sizes, caps, n, seed)
    cells_of = matrix.select("block", F.posexplode("row").alias("cell", "n")).where("n > 0")
    # a block's stretches cover its rows; each begins where the cells before it end
    lo = F.sum("n").over(Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    dealt = materialize(cells_of.select("block", lo.alias("at"), "cell"), "shard-matrix")

    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")
    placed = blocks.withColumn("at", (F.row_number().over(local) - 1).cast("long"))
    # rows and the beginnings of stretches in one order: a row's cell is that of the last beginning
    placed = placed.withColumn("cell", F.lit(None).cast("int")).withColumn("side", F.lit(1)).unionByName(dealt.withColumn("side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("cell", F.last("cell", ignorenulls=True).over(so_far)).where("side = 1").select(*plain.columns, "cell")
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "rid"), "rid")
    placed = placed.withColumn("at", F.row_number().over(again) - 1)
    out = placed.join(F.broadcast(bounds.select(F.col("id").alias("cell"), "shard", "first")), "cell")
    return out.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)), F.col("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot"))


def shard_report(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Where every document goes; only its id, size and crc travel."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard(thin, n_shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 20240229) -> None:
    """Write the shuffled rows as one folder per shard, each in slot order, in parts of bounded size."""
    out = shard(docs, n_shards, seed).withColumn("part", F.floor(F.col("slot") / F.lit(ROWS_PER_CELL)))
    out.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)
