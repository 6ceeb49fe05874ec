"""Connected components of an edge table of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import sets
from .common import shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", stored: bool = True) -> DataFrame:
    """(node, component) of every node of edges; component is its smallest node. See sets.connected_components."""
    shared_dir(edges.sparkSession)
    return sets.connected_components(edges.select(edges[a].cast("long").alias("a"), edges[b].cast("long").alias("b")), stored=stored)
