"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a number from 0 to N-1 in the order of hash buckets and, in a bucket, of the key columns.  A keyed Feistel
network over the smallest 2^b >= N permutes the numbers; values of N or more are walked on along their cycle until they fall
below N.  Permuted number p goes to shard p mod n at slot p div n: counts differ by one at most, slots have no gap, and both
directions can be computed for any row number without the data.

Edge cases: a null text counts as none (size 1, CRC 0); null ids are a value like any other; rows that are equal in all columns
are numbered one after another (they are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

ROUNDS = 6
SEED = 20240229
#: Copies of one row that one task numbers.
RANGE = 10_000
#: Numbering buckets: about one for this many rows, and never more than MOST_BUCKETS (so that their offsets stay small).
BUCKET_ROWS = 20_000
MOST_BUCKETS = 65_536


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, int(n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round_keys(seed: int) -> np.ndarray:
    return C.mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed % (1 << 63)))


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """One pass of the network.  Rounds alternate which part of the word is changed, so its two parts may differ in width."""
    low, high = _widths(n)
    lo_mask, hi_mask = np.uint64((1 << low) - 1), np.uint64((1 << high) - 1)
    lo, hi = x & lo_mask, x >> np.uint64(low)
    keys = _round_keys(seed)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2:
            lo = lo ^ (C.mix64(hi ^ keys[r]) & lo_mask)
        else:
            hi = hi ^ (C.mix64(lo ^ keys[r]) & hi_mask)
    return (hi << np.uint64(low)) | lo


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (``back``: its inverse) by cycle walking."""
    y = _network(np.asarray(x, np.uint64), n, seed, back)
    while (out := np.nonzero(y >= np.uint64(n))[0]).size:
        y[out] = _network(y[out], n, seed, back)
    return y.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a global row number, without reading data."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """Global row number that stands at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` (long, 0 to N-1), and N.  Reproducible: it depends on the rows alone, not on files or tasks.

    Equal rows are counted before the shuffle and numbered as ranges of at most RANGE, which are dealt out where there are several,
    so copies of one row don't meet in a task.
    """
    cols = df.columns
    rows = C.stage(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__wl_n")), f"{name}-distinct")
    total, distinct, most = rows.agg(F.coalesce(F.sum("__wl_n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("__wl_n"), F.lit(0))).first()
    buckets = max(1, min(MOST_BUCKETS, distinct // BUCKET_ROWS))
    rows = rows.withColumn("__wl_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    sums = rows.groupBy("__wl_b").agg(F.sum("__wl_n").alias("__wl_s"))
    w = W.orderBy("__wl_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.select("__wl_b", (F.sum("__wl_s").over(w) - F.col("__wl_s")).alias("__wl_0"))
    inner = W.partitionBy("__wl_b").orderBy(*cols).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__wl_i", F.sum("__wl_n").over(inner) - F.col("__wl_n"))
    rows = rows.join(F.broadcast(starts), "__wl_b")  # MOST_BUCKETS rows at most
    rows = rows.withColumn("__wl_a", F.col("__wl_0") + F.col("__wl_i"))
    if most > RANGE:
        rows = rows.withColumn("__wl_r", F.explode(F.sequence(F.lit(0), F.expr(f"(__wl_n - 1) div {RANGE}"))))
        rows = rows.withColumn("__wl_a", F.col("__wl_a") + F.col("__wl_r") * RANGE).withColumn("__wl_n", F.least(F.lit(RANGE), F.col("__wl_n") - F.col("__wl_r") * RANGE))
        rows = rows.repartition(F.xxhash64("__wl_a"))
    return rows.select(*cols, F.explode(F.sequence(F.col("__wl_a"), F.col("__wl_a") + F.col("__wl_n") - 1)).alias("row_number")), total


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (int) and ``slot`` (long)."""
    rows, n = number_rows(df)
    n = max(n, 1)

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return (
        rows.withColumn("__wl_p", permuted("row_number"))
        .withColumn("shard", F.pmod("__wl_p", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"__wl_p div {shards}"))
        .drop("__wl_p")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
