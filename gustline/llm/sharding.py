"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..N-1 in (id, content) order; a keyed Feistel network over the smallest even
number of bits that holds N, walked until the value falls below N, permutes those numbers. Position p goes to
shard ``p mod shards`` and slot ``p div shards``: both are computable from the row number alone, and the row
number from shard and slot (:func:`row_of`). The law is ``rows``: shard sizes differ by one at most.

Defined results: a null text has size 8 and the checksum of the empty text; rows with equal ids are ordered by
checksum and size (rows equal in all three are interchangeable); null ids come first; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.shared import stash

ROUNDS = 4


def _half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced Feistel domain that holds ``n`` values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(x) for x in np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)]


def permute(rows: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse) at ``rows``."""
    x = np.asarray(rows, np.uint64).copy()
    if not len(x):
        return x.astype(np.int64)
    half = _half_bits(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _keys(seed)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row numbers at (shard, slot)."""
    return permute(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, inverse=True)


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    # partition and offset of every row in global order, fixed by writing them down
    put = stash(thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    here = F.shiftrightunsigned("at", 33)
    counts = sorted((r["part"], r["n"]) for r in put.groupBy(here.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    n, starts = 0, []
    for part, k in counts:
        starts.append((part, n))
        n += k
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, "part long, start long")

    @F.pandas_udf("struct<shard:long,slot:long>")
    def placed(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard, "slot": slot})

    numbered = put.join(F.broadcast(offsets), here == F.col("part")).withColumn("row_number", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.withColumn("to", placed("row_number")).select("doc_id", "size", "text_crc32", "row_number", F.col("to.shard").cast("int").alias("shard"), F.col("to.slot").alias("slot"))
