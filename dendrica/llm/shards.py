"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in blocks (partitions). How many rows each block sends to each shard is
drawn first, exactly: a multivariate hypergeometric matrix whose row sums are
the blocks and whose column sums are the shards. Each block is permuted locally
and cut by its matrix row, the pieces are exchanged, and each shard is permuted
again. Every order of rows is equally likely, and shard sizes differ by one at
most.

A shard is cut into lanes of at most `lane_rows` rows, drawn as columns of the
matrix too, so that no task sorts a whole shard and slots need no second count.

All columns come along, whatever their names: one named `shard` or `slot` has its
name lengthened by `_`. Null texts have size 16 and crc 0; null doc_ids and repeated rows are rows like
others; with fewer rows than shards some shards are empty; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, table

SHARDS, LANE_ROWS, BLOCKS, SEED = 40, 16_000_000, 1024, 20240229


def _stirling(n: int) -> float:
    """log n! less Stirling's n log n - n + log(2 pi n) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    x = 1.0 / (n * n)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where the two are near."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        out, e, j = (x - mean) * v, 2 * x * v, 1
        while True:
            e *= v * v
            if (now := out + e / (2 * j + 1)) == out:
                return out
            out, j = now, j + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """Log of the binomial probability, by saddle point (Loader, 2000): exact to rounding at any size, where sums of lgamma lose digits."""
    q = 1 - p
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    return _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def probability(x: int, good: int, bad: int, n: int) -> float:
    """Of x good ones among n drawn without return."""
    p = n / (good + bad)
    if not 0 < p < 1:
        return 1.0
    return math.exp(_binomial(x, good, p) + _binomial(n - x, bad, p) - _binomial(n, good + bad, p))


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without return: inversion, from the mode outwards."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p0 = probability(mode, good, bad, n)
    u, up, down, pu, pd = rng.random() - p0, mode, mode, p0, p0
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def matrix(blocks: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each block to each column; row and column sums are as given."""
    rng, room, out = random.Random(seed), list(columns), []
    for size in blocks:
        row, left, total = [], size, sum(room)
        for c in room:
            x = hypergeometric(rng, c, total - c, left)
            row.append(x)
            left, total = left - x, total - c
        room = [c - x for c, x in zip(room, row, strict=True)]
        out.append(row)
    return out


def _place(ends: Column, index: Column, columns: int) -> Column:
    """First column whose end lies beyond index, by bisection."""
    steps = max(1, math.ceil(math.log2(max(columns, 2))) + 1)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(ends, mid) <= index
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(columns - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"])


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, lane_rows: int = LANE_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """df with `shard` and `slot` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    rows = table(df.select(F.struct(*apart(df, ("shard", "slot")), F.lit(0)).alias("row")))
    cols = rows.schema["row"].dataType.names[:-1]
    placed = rows.coalesce(blocks).withColumn("__r", F.xxhash64(F.lit(seed), "row")).sortWithinPartitions("__r")
    placed = table(placed.select("row", F.spark_partition_id().alias("__block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__index")))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__block").count().collect())  # at most `blocks` rows
    n = sum(c for _, c in counts)
    lanes = max(1, math.ceil(n / (shards * lane_rows)))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    columns = [size // lanes + (lane < size % lanes) for size in sizes for lane in range(lanes)]
    drawn = matrix([c for _, c in counts], columns, seed)
    ends = []
    for (block, _), row in zip(counts, drawn, strict=True):
        total, cut = 0, []
        for x in row:
            total += x
            cut.append(total)
        ends.append((block, cut))
    plan = spark.createDataFrame(ends, "`__block` int, `__ends` array<long>")
    if len(ends) * len(columns) * 8 <= 32 << 20:  # else Spark chooses the join
        plan = F.broadcast(plan)
    out = placed.join(plan, "__block").withColumn("__column", _place(F.col("__ends"), F.col("__index"), len(columns)))
    out = out.select("row", F.col("__block"), F.col("__index"), F.expr(f"CAST(`__column` DIV {lanes} AS INT)").alias("shard"), F.expr(f"CAST(`__column` % {lanes} AS INT)").alias("__lane"))
    size = F.lit(n // shards) + F.when(F.col("shard") < n % shards, 1).otherwise(0)
    start = F.expr("`__lane` * (`__n` DIV {0}) + least(`__lane`, `__n` % {0})".format(lanes))
    within = F.expr("row_number() OVER (PARTITION BY shard, `__lane` ORDER BY `__again`, `__block`, `__index`)")
    out = out.withColumns({"__n": size.cast("long"), "__again": F.xxhash64(F.lit(seed + 1), "__block", "__index")})
    return out.select(*(F.col("row").getField(c).alias(c) for c in cols), "shard", (start + within - 1).cast("long").alias("slot"))
