"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn before any row moves, from the
multivariate hypergeometric law that a uniform permutation of all rows would induce. Each block then permutes its
own rows and deals them out by these counts, rows are exchanged, and each shard permutes what it received. All of it
is DataFrame operations; the driver only draws the matrix (blocks x shards counts) from the blocks' row counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, checkpointed, column


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """[block, shard] counts with these margins, distributed as under a uniform permutation."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(shard_rows, np.int64)
    out = np.zeros((len(block_rows), len(shard_rows)), np.int64)
    for i, n in enumerate(block_rows):
        rest, pool = int(n), int(left.sum())
        for j in range(len(left)):  # one draw per cell
            pool -= int(left[j])
            if rest and left[j]:
                take = rest if pool == 0 else _hypergeometric(rng, int(left[j]), pool, rest)
                out[i, j] = take
                rest -= take
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw, by numpy up to its limit of 10^9."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    return _by_inversion(rng, good, bad, draws)


def _by_inversion(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The same law at any size: probabilities grow from their mode by exact ratios, and a uniform number picks among them.

    What lies more than 14 standard deviations off has a probability below 1e-40, less than a double can tell from none.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = 40 + int(14 * (draws * (good / total) * (bad / total)) ** 0.5)
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(float(bad - draws) + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weight = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def shuffle_into_shards(df: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, rows_per_block: int = 1 << 20, least_blocks: int = 64, runs_per_shard: int | None = None) -> DataFrame:
    """A uniform random order of df's rows, cut into `shards` shards whose row counts differ by one at most.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot (0.. in each shard), grown_shard (null). Size is the
    text's UTF-8 bytes plus 8. Null text: no bytes and the CRC of the empty string. Null ids and repeated rows are
    ordinary rows: each row draws its own random numbers, which are written before they are used, so that a task that
    runs again finds the same. Fewer rows than shards: shards of one row or none. An empty table gives an empty
    result. Other columns of df are not read.

    Rows with equal texts are not held together: that would break the uniform law and the exact sizes.
    """
    rows = df.select(
        column(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(column(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(column(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = checkpointed(rows.select("*", F.rand(seed).alias("r0"), F.rand(seed + 1).alias("r1"), F.rand(seed + 2).alias("r2")))
    blocks = blocks_for(rows.count(), rows_per_block, least_blocks)
    rows = rows.withColumn("block", F.floor(F.col("r0") * blocks).cast("int"))
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `blocks` rows
    held = [counts.get(b, 0) for b in range(blocks)]
    n = sum(held)
    matrix = communication_matrix(held, [n // shards + (j < n % shards) for j in range(shards)], seed)
    bounds = np.cumsum(matrix, axis=1)
    deal = df.sparkSession.createDataFrame([(b, [int(x) for x in bounds[b]]) for b in range(blocks)], "block int, upto array<long>")

    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("r1", "r0", "doc_id")) - 1)
    dealt = ranked.join(F.broadcast(deal), "block").withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("r"))).cast("int"))

    # the second permutation: the leading part of a random number cuts a shard into runs, which tasks sort side by side
    runs = runs_per_shard or blocks_for(n // max(1, shards), rows_per_block, 8)
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.col("r2").alias("key"), F.floor(F.col("r2") * runs).cast("int").alias("run"))
    tally = dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = tally.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_run = dealt.withColumn("k", F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "doc_id")) - 1)
    return in_run.join(F.broadcast(before.select("shard", "run", "before")), ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
