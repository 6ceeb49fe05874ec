"""Combinations, first-wins deduplication and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BACKBONE_LABEL


def combinations(items: DataFrame, group: list[str], item: str, order: str) -> DataFrame:
    """All subsets of one and two items of each group, as arrays in order.

    The order is a number that is unique in its group. Pairs are a self equi-join on the group.
    """
    one = items.select(*group, F.lit(1).alias("size"), F.array(item).alias("items"))
    a, b = items.select(*group, F.col(item).alias("__a"), F.col(order).alias("__oa")), items.select(*group, F.col(item).alias("__b"), F.col(order).alias("__ob"))
    two = a.join(b, group).where("__oa < __ob").select(*group, F.lit(2).alias("size"), F.array("__a", "__b").alias("items"))
    return one.unionByName(two)


def label_variants(combos: DataFrame, labels: str = "items") -> DataFrame:
    """Each place as its amino acid or as backbone; GLY as backbone only. Distinct rows."""

    def choices(c: Column) -> Column:
        return F.when(c == "GLY", F.array(F.lit(BACKBONE_LABEL))).otherwise(F.array(c, F.lit(BACKBONE_LABEL)))

    rest = [c for c in combos.columns if c != labels]
    one = combos.where(F.size(labels) == 1).select(*rest, F.explode(choices(F.col(labels)[0])).alias("v1")).select(*rest, F.array("v1").alias(labels))
    two = combos.where(F.size(labels) == 2).select(*rest, labels, F.explode(choices(F.col(labels)[0])).alias("v1")).select(*rest, "v1", F.explode(choices(F.col(labels)[1])).alias("v2")).select(*rest, F.array("v1", "v2").alias(labels))
    return one.unionByName(two).distinct()


def first_wins(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key isn't in found; a null key is in nothing."""
    return wanted.join(found.select(key).distinct(), key, "left_anti")


def overlap_edges(sites: DataFrame, molecule: list[str], site: str, atoms: str) -> DataFrame:
    """Pairs of sites that share at least half of the larger one's atoms."""
    each = sites.select(*molecule, F.col(site), F.size(F.array_distinct(atoms)).alias("n"), F.explode(F.array_distinct(atoms)).alias("atom"))
    a, b = each.withColumnRenamed(site, "a").withColumnRenamed("n", "na"), each.withColumnRenamed(site, "b").withColumnRenamed("n", "nb")
    return a.join(b, [*molecule, "atom"]).where("a < b").groupBy(*molecule, "a", "b", "na", "nb").agg(F.count("*").alias("both")).where(2 * F.col("both") >= F.greatest("na", "nb")).select(*molecule, "a", "b")


#: Edges that a task unites at once.
STRETCH = 1 << 20


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of the edges u - v."""
    name, end = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = end[: len(u)], end[len(u) :]
    root = np.arange(len(name))
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return name, name[root]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = x[apart], y[apart]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in local_roots(u, v)], names=["node", "root"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STRETCH:
            yield out()
    if sum(b.num_rows for b in held):
        yield out()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """node, component (its least node) by contraction; edges: a, b; nodes adds nodes without edges.

    Each task unites the edges of its stretches by itself and names every node's local root.
    Grouped by node, the roots that a node has in several stretches become the next round's edges;
    a node that is no root in any stretch has its pointer and leaves. So a hub of any degree is
    one row for each stretch that holds it, and a round's edges join the last round's roots only.
    As many tasks are used as the edges have stretches; while there are several, from the second
    round on each edge lies with both of its ends, so that chains of roots shorten every round.
    At last the pointers are followed back by equi-joins. Rounds are cut with checkpoint() in the
    folder of spark.checkpoint.dir; edges that are stored already (stored) aren't copied there.
    Edges with a null end are left out; self-loops keep their node.
    """
    ready_checkpoints(edges.sparkSession)
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u is not null and v is not null")
    e = e if stored else e.checkpoint()
    left, rounds = e.count(), []
    while left or not rounds:
        tasks = left // STRETCH + 1
        e = e.coalesce(tasks)
        if rounds and tasks > 1:
            e = e.mapInArrow(_united, "node long, root long").toDF("u", "v").where("u != v")
            e = e.union(e.select("v", "u")).repartition("u")
        seen = e.mapInArrow(_united, "node long, root long").groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")).checkpoint()
        rounds.append(seen)
        e = seen.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("least").alias("v")).where("u != v")
        left = e.count()
    known = None
    for seen in reversed(rounds[1:]):
        own = _followed(seen.where(~F.array_contains("roots", F.col("node"))), known)
        known = own if known is None else own.union(known)
    out = _followed(rounds[0], known)
    kind = edges.schema["a"].dataType
    if nodes is not None:
        every = rounds[0].select("node").union(nodes.select(F.col("node").cast("long"))).distinct()
        out = every.join(out, "node", "left")
    return out.select(F.col("node").cast(kind), F.coalesce("component", "node").cast(kind).alias("component"))


def _followed(seen: DataFrame, known: DataFrame | None) -> DataFrame:
    """node, component of a round's nodes by their least root and what later rounds know of it."""
    own = seen.select("node", F.col("least").alias("component"))
    if known is None:
        return own
    further = known.select(F.col("node").alias("component"), F.col("component").alias("far"))
    return own.join(further, "component", "left").select("node", F.coalesce("far", "component").alias("component"))


def ready_checkpoints(spark) -> None:
    """Use spark.checkpoint.dir. Only a local session without it (tests) gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            path = "file://" + tempfile.mkdtemp(prefix="corvane-")
        context.setCheckpointDir(path)
