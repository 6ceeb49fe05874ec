"""Ranking, walking and splitting by order."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import ready_checkpoints


def pose_ranks(scores: DataFrame, group: list[str], score: str = "score", name: str = "sample", true_pose: Column | None = None) -> DataFrame:
    """Rank of each pose by falling score, equal scores by name; or of the true pose only."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), name)))
    return out if true_pose is None else out.where(true_pose)


def ordered_by_members(groups: DataFrame, within: str, n: str, first: str) -> DataFrame:
    """Place of each row of a group by falling n, then by first seen."""
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(F.desc(n), first)).cast("bigint"))


def renumbered(clusters: DataFrame, within: list[str], size: str = "size", old: str = "cluster") -> DataFrame:
    """New ids from 1 by falling size, equal sizes in the old order."""
    return clusters.withColumn("new_id", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(size), old)).cast("bigint"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `row_number`, gapless from 0 in order; equal rows in the order they are read.

    Rows are dealt by range and sorted in their partition, and only the partitions' counts go to
    the driver. The row's place is the last key, so that equal rows are dealt over partitions too.
    """
    ready_checkpoints(rows.sparkSession)
    keys = [*order, "__place"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__place").checkpoint()
    counts = {r["p"]: r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=0) + 1)), initial=0))
    base = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts)), F.spark_partition_id() + 1)
    return ranged.withColumn("row_number", base + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def batches(rows: DataFrame, n: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Contiguous batches 1..n in order, the first ones larger by the remainder.

    Rows are numbered over all groups by range, so that neither one group nor rows without a
    group meet in one task; a group's first number and size are one small row each.
    """
    out = numbered(rows, [*(group or []), *order])
    each = out.groupBy(*(group or [])).agg(F.min("row_number").alias("__first"), F.count("*").alias("__n"))
    if group:
        keys = each.select(*(F.col(c).alias(f"__{c}") for c in group), "__first", "__n")
        out = out.join(keys, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])).drop(*(f"__{c}" for c in group))
    else:
        out = out.crossJoin(F.broadcast(each))  # one row
    small, more = F.expr(f"__n div {n}"), F.col("__n") % n
    at = F.col("row_number") - F.col("__first")
    large = (small + 1) * more  # rows in the larger batches
    batch = F.when(at < large, F.floor(at / (small + 1))).otherwise(more + F.floor((at - large) / F.greatest(small, F.lit(1))))
    return out.withColumn("batch", (batch + 1).cast("bigint")).drop("row_number", "__first", "__n")


def strided(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Batches 1..n by turns in order: the first row to the first, the next to the second."""
    return numbered(rows, order).withColumn("batch", (F.col("row_number") % n + 1).cast("bigint")).drop("row_number")


def chain_walk(residues: DataFrame, group: list[str], order: list[str], gap: Column, k: int = 2) -> DataFrame:
    """Flanking places -k..k of every residue, cut off at the first break outward.

    gap: whether there is a break between a row and the one before it. Adds `run`, the number of
    breaks before a row, and before_i / after_i: whether the row i places away is in the same run.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    # the first row of a group has none before it, so what gap says there (often null) is no break
    g = residues.withColumn("__gap", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(gap, F.lit(True)).cast("int")))
    g = g.withColumn("run", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    for i in range(1, k + 1):
        g = g.withColumn(f"before_{i}", F.coalesce(F.lag("run", i).over(w) == F.col("run"), F.lit(False))).withColumn(f"after_{i}", F.coalesce(F.lead("run", i).over(w) == F.col("run"), F.lit(False)))
    return g.drop("__gap")


def sorted_pairs(labels: Column, payload: Column) -> Column:
    """Labels and payloads sorted by label only; equal labels keep their order."""
    both = F.zip_with(labels, payload, lambda a, b: F.struct(a.alias("l"), b.alias("p")))
    return F.array_sort(F.transform(both, lambda z, i: F.struct(z["l"].alias("label"), i.alias("at"), z["p"].alias("payload"))))


def argmin(rows: DataFrame, group: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of the least value of each group, equal ones by tie columns. Partial aggregation, no sort."""
    rest = [c for c in rows.columns if c not in group]
    best = rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(value, *tie)).alias("b"))
    return best.select(*group, "b.*")


def argmin_stopping(rows: DataFrame, group: list[str], value: str, order: str, excellent: float = 0.4) -> DataFrame:
    """The least value among the rows up to the first excellent one in order (that early stop)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("__stop", F.coalesce(F.max((F.col(value) <= excellent).cast("int")).over(w), F.lit(0)))
    return argmin(seen.where("__stop = 0").drop("__stop"), group, value, [order])


def first_match(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in order."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*group, "b.*")
