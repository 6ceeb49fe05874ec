"""Gaussian kernel density on a grid, and its DX text form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kde_grid(points: DataFrame, steps: int = 50, pad: float = 5.0, bandwidth: float = 0.2) -> DataFrame:
    """Density of points (x, y, z) at steps**3 places: ix, iy, iz, x, y, z, density.

    The kernel's covariance is the sample covariance times bandwidth squared. One pass takes the
    moments, a single row; in the second each task adds its points to a grid of its own in numpy,
    and only these grids are shuffled, whatever the number of points. No points or points in one
    plane give no rows.
    """
    pts = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).where("x is not null and y is not null and z is not null")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    m = pts.agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(a + b) for a, b in pairs), *(F.min(c).alias(f"{c}0") for c in "xyz"), *(F.max(c).alias(f"{c}1") for c in "xyz")).first()
    shape = "ix int, iy int, iz int, x double, y double, z double, density double"
    spread = np.array([[(m[min(a, b) + max(a, b)] or 0.0) * bandwidth**2 for b in "xyz"] for a in "xyz"])
    if not m["n"] or not np.isfinite(spread).all() or np.linalg.det(spread) <= 0:
        return points.sparkSession.createDataFrame([], shape)
    inverse, norm = np.linalg.inv(spread), m["n"] * np.sqrt((2 * np.pi) ** 3 * np.linalg.det(spread))
    axes = [np.linspace(m[f"{c}0"] - pad, m[f"{c}1"] + pad, steps) for c in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((steps, steps, steps)), False
        for batch in batches:
            for p in np.column_stack([c.to_numpy() for c in batch.columns]):
                some = True
                dx, dy, dz = (axis - v for axis, v in zip(axes, p))
                # the form in parts of one and two axes
                xy = inverse[0, 0] * dx[:, None] ** 2 + inverse[1, 1] * dy[None] ** 2 + 2 * inverse[0, 1] * dx[:, None] * dy[None]
                xz = 2 * inverse[0, 2] * dx[:, None] * dz[None] + inverse[2, 2] * dz[None] ** 2
                yz = 2 * inverse[1, 2] * dy[:, None] * dz[None]
                total += np.exp(-0.5 * (xy[:, :, None] + xz[:, None, :] + yz[None]))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps**3, dtype=np.int32)), pa.array(total.ravel())], names=["at", "s"])

    grid = pts.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    place = {k: F.expr(e).cast("int") for k, e in (("ix", f"at div {steps * steps}"), ("iy", f"(at div {steps}) % {steps}"), ("iz", f"at % {steps}"))}
    value = lambda c, axis: F.lit(float(axis[0])) + F.col(c) * F.lit(float(axis[-1] - axis[0]) / (steps - 1))
    return grid.select(*(v.alias(k) for k, v in place.items()), "s").select("ix", "iy", "iz", *(value(f"i{c}", axis).alias(c) for c, axis in zip("xyz", axes)), (F.col("s") / F.lit(float(norm))).alias("density"))


def dx_lines(grid: DataFrame, steps: int) -> DataFrame:
    """place, value: the lines of a DX file, three numbers each, first axis fastest."""
    place = (F.col("iz").cast("long") * steps + F.col("iy")) * steps + F.col("ix")
    body = grid.withColumn("p", place).groupBy(F.floor(F.col("p") / 3).alias("row")).agg(F.array_sort(F.collect_list(F.struct("p", "density"))).alias("v"))
    lines = body.select((F.col("row") + 7).alias("place"), F.array_join(F.transform("v", lambda v: F.format_string("%.6e", v["density"])), " ").alias("value"))
    e = grid.agg(*(F.min(k).alias(f"{k}0") for k in "xyz"), *(((F.max(k) - F.min(k)) / (steps - 1)).alias(f"d{k}") for k in "xyz"))
    n = str(steps)
    head = [
        F.lit(f"object 1 class gridpositions counts {n} {n} {n}"), F.concat_ws(" ", F.lit("origin"), "x0", "y0", "z0"), F.concat(F.lit("delta "), "dx", F.lit(" 0 0")), F.concat(F.lit("delta 0 "), "dy", F.lit(" 0")), F.concat(F.lit("delta 0 0 "), "dz"),
        F.lit(f"object 2 class gridconnections counts {n} {n} {n}"), F.lit(f"object 3 class array type double rank 0 items {steps**3} data follows"),
    ]
    top = e.select(F.posexplode(F.array(*head)).alias("place", "value")).select(F.col("place").cast("long"), "value")
    end = e.select(F.lit(steps**3 // 3 + 8).cast("long").alias("place"), F.lit("object 'density' class field").alias("value"))
    return top.unionByName(lines).unionByName(end)
