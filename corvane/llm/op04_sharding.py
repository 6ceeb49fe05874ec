"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of (doc_id, size, checksum), which doesn't depend on files or
partitions. A keyed Feistel network permutes [0, 4**k) with 4**k at least the number of rows;
values outside the rows' range walk on until they fall inside, so the whole is a permutation of
the row numbers. Position p lies in shard p mod n at slot p div n: counts of any two shards
differ by one at most, and any row's place can be computed from its number alone, back and forth.

Defined results: a null text has no bytes (size 16, checksum 0); null ids are numbered first;
repeated rows get different numbers, in any order among equal ones; an empty table gives an
empty result. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textcore import mix

ROUNDS = 4


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    salt = ((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) ^ (r << 7)) % 2**64
    return mix(x ^ np.uint64(salt)) & mask


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each row number x in [0, n)."""
    k = _half_bits(n)
    half, mask = np.uint64(k), np.uint64((1 << k) - 1)
    out = np.asarray(x, np.uint64).copy()
    left_over = np.arange(len(out))
    while len(left_over):
        v = out[left_over]
        a, b = v >> half, v & mask
        for r in range(ROUNDS):
            a, b = b, a ^ _round(b, key, r, mask)
        v = (a << half) | b
        out[left_over] = v
        left_over = left_over[v >= np.uint64(n)]
    return out.astype(np.int64)


def invert(p: np.ndarray, n: int, key: int) -> np.ndarray:
    """The row number at each place p: the inverse of permute()."""
    k = _half_bits(n)
    half, mask = np.uint64(k), np.uint64((1 << k) - 1)
    out = np.asarray(p, np.uint64).copy()
    left_over = np.arange(len(out))
    while len(left_over):
        v = out[left_over]
        a, b = v >> half, v & mask
        for r in reversed(range(ROUNDS)):
            a, b = b ^ _round(a, key, r, mask), a
        v = (a << half) | b
        out[left_over] = v
        left_over = left_over[v >= np.uint64(n)]
    return out.astype(np.int64)


def place(number: np.ndarray, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    p = permute(number, n, key)
    return p % shards, p // shards


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """df with a gapless `row_number` from 0 in the given order, and the number of rows.

    Rows are dealt by range and sorted in their partition; only the rows' count of each partition
    goes to the driver. The row's place in df is the last key, so that equal rows, however many,
    are dealt over partitions too.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "__place"]
    ranged = saved(df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__place"))
    counts = {r["p"]: r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    base = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts or [0])), F.spark_partition_id() + 1)
    return ranged.withColumn("row_number", base + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), total


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 20240611, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of every row; texts aren't shuffled."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"))
    rows, total = numbered(slim, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed))

    p = rows.withColumn("position", position("row_number"))
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
