"""Rows that meet all rows of their key, as blocks: arrays against arrays, not rows against rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a block.
ROWS = 256


def _packed(df: DataFrame, keys: list[str], pack: Callable[[pd.DataFrame], object]) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, list[pd.DataFrame]] = {}

        def block(key: tuple) -> pd.DataFrame:
            rows = pd.concat(waiting.pop(key), ignore_index=True)
            return pd.DataFrame([(*key, pickle.dumps(pack(rows)))], columns=[*keys, "block"])

        for part in parts:
            for key, own in part.groupby(keys, sort=False):
                for at in range(0, len(own), ROWS):
                    one = own.iloc[at : at + ROWS]
                    if sum(map(len, waiting.get(key, ()))) + len(one) > ROWS:
                        yield block(key)
                    waiting.setdefault(key, []).append(one)
        for key in list(waiting):
            yield block(key)

    return df.mapInPandas(run, f"{kinds}, block binary")


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], by: tuple[Column, Column], pack: tuple[Callable, Callable], run: Callable[[object, object, tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batches that run makes of each pair of a left and a right block of equal keys; null keys meet nothing.

    A key's left rows are dealt over tasks by a hash of `by`, and its right blocks go to each of
    these, so that a large key is many tasks. pack makes a block's object of its rows.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = min(parts, max(8, spark.sparkContext.defaultParallelism))

    def dealt(df: DataFrame, c: Column) -> DataFrame:
        return df.dropna(subset=keys).withColumn("__deal", F.pmod(F.xxhash64(c), F.lit(deal)).cast("int")).repartition(parts, *keys, "__deal")

    a = _packed(dealt(left, by[0]), [*keys, "__deal"], pack[0]).withColumnRenamed("block", "__left")
    b = _packed(dealt(right, by[1]).drop("__deal"), keys, pack[1]).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))).withColumnRenamed("block", "__right")
    # dealt by number, so that adaptive execution doesn't make a few large tasks of small blocks
    a, b = (df.repartition(parts, *keys, "__deal") for df in (a, b))
    met = a.hint("merge").join(b, [*keys, "__deal"]).select(*keys, "__left", "__right")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *key, x, y = (c[i].as_py() for c in batch.columns)
                yield from run(pickle.loads(x), pickle.loads(y), tuple(key))

    return met.mapInArrow(each, schema)
