"""Matching query binding sites against the library by superposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BACKBONE_LABEL
from ..functions.arrays import label_assignments
from ..functions.geometry import all_rmsds
from .blocks import block_pairs

MATCHES = (
    "pdbfile string, sample string, struct_id string, frag string, subset_size int, bsr_combo string, aa_bucket string, vdg_index int, "
    "vdg_cluster_id int, vdg_rmsd double, aa_perm_idx int, q_site_idx int, q_cg_perm_idx int"
)
_QUERY = ["pdbfile", "sample", "struct_id", "bsr_combo", "labels", "q_bb", "q_cg", "q_sites"]
_KEYS = ["frag", "subset_size", "aa_bucket"]
#: Superpositions of one array operation.
_AT_ONCE = 1 << 14


def _coords(v) -> np.ndarray:
    return np.array([np.array([np.asarray(p, float) for p in r]) for r in v], float)


def _points(v) -> np.ndarray:
    return np.array([np.asarray(p, float) for p in v], float).reshape(-1, 3)


def _queries(p: pd.DataFrame) -> dict:
    """Columns of a block of queries, its rows grouped by labels and shapes of their points."""
    bb, cgs = [_coords(v).reshape(-1, 3) for v in p["q_bb"]], [[_points(c) for c in v] for v in p["q_cg"]]
    groups: dict[tuple, list[int]] = {}
    for i, labels in enumerate(p["labels"]):
        groups.setdefault((tuple(labels), len(bb[i]), tuple(map(len, cgs[i]))), []).append(i)
    sites = [[(x["site"], x["perm"]) for x in v] for v in p["q_sites"]]
    made = [(labels, n, [(k, size, np.stack([np.concatenate([bb[i], cgs[i][k]]) for i in at])) for k, size in enumerate(sizes)], np.array(at), np.array([[sites[i][k] for k in range(len(sizes))] for i in at], int)) for (labels, n, sizes), at in groups.items()]
    return {"groups": made, "text": {c: pa.array(p[c], pa.string()) for c in ("pdbfile", "sample", "struct_id", "bsr_combo")}}


def _library(p: pd.DataFrame) -> dict:
    """Columns of a block of the library, its rows grouped by residues and shapes of their points."""
    bb, cg = [_coords(v) for v in p["bb_coords"]], [_points(v) for v in p["cg_coords"]]
    groups: dict[tuple, list[int]] = {}
    for i, aas in enumerate(p["lib_aas"]):
        groups.setdefault((tuple(aas), bb[i].shape, len(cg[i])), []).append(i)
    made = [(aas, n, np.stack([bb[i] for i in at]), np.stack([cg[i] for i in at]), np.array(at)) for (aas, _, n), at in groups.items()]
    return {"groups": made, "ints": {c: pa.array(p[c], pa.int32(), from_pandas=True) for c in ("vdg_index", "vdg_cluster_id")}}


def pose_match(queries: DataFrame, library: DataFrame, threshold: float = 0.7, every_hit: bool = False, strict: bool = False, excellent: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """The best fit of each library row to each query combination, up to the threshold.

    queries: pdbfile, sample, struct_id, frag, subset_size, bsr_combo, aa_bucket, labels (sorted),
    q_bb (backbone points of each residue), q_cg (points of each placing of the group) and q_sites
    (struct of site and permutation of each placing). library: schemas.NR_VDGS with vdg_index.

    The two meet on fragment, size and bucket, in blocks; the wildcard label stands in the bucket
    of both. All pairs of two blocks that have equally many points and equal assignments are
    superposed in one array operation.
    every_hit: all fits, not the best of each pair. strict: below the threshold, rounded to two
    places first. excellent: stop at the first assignment with so good a fit. columns: those of
    MATCHES that are wanted; no others are made.
    """
    kinds = [x for x in MATCHES.split(", ") if columns is None or x.split()[0] in columns]
    names = [x.split()[0] for x in kinds]
    lib = library.select(*_KEYS, "vdg_index", F.col("cluster_id").alias("vdg_cluster_id"), "cg_coords", "bb_coords", F.transform("scrr", lambda s: s["resname"]).alias("lib_aas"))

    def hits(ys: list[np.ndarray], xs: list[np.ndarray]) -> tuple:
        """Query, library row, assignment, placing and RMSD of the fits that count. ys by placing, xs by assignment."""
        d = np.stack([all_rmsds(y, x) for x in xs for y in ys])
        n, k = np.divmod(np.arange(len(d)), len(ys))
        own = (np.round(d, 2) < threshold) if strict else d <= threshold
        if excellent is not None:  # assignments after the first with so good a fit aren't tried
            stop = np.where(d <= excellent, n[:, None, None], len(xs)).min(0)
            own &= n[:, None, None] <= stop
        if every_hit:
            f, q, r = np.nonzero(own)
        else:
            d = np.where(own, d, np.inf)
            best = d.argmin(0)  # of equal ones the first assignment, then the first placing
            q, r = np.nonzero(own.any(0))
            f = best[q, r]
        return q, r, n[f], k[f], d[f, q, r]

    def run(block: dict, other: dict, key: tuple) -> Iterator[pa.RecordBatch]:
        for labels, n_bb, placings, q_at, sites in block["groups"]:
            for aas, n_cg, bb, cg, l_at in other["groups"]:
                usable = [(k, y) for k, size, y in placings if size == n_cg]
                orders = label_assignments(aas, labels, BACKBONE_LABEL) if usable else ()
                xs = [np.concatenate([bb[:, list(o)].reshape(len(bb), -1, 3), cg], 1) for o in orders]
                if not xs or xs[0].shape[1] != n_bb + n_cg:
                    continue
                step = max(1, _AT_ONCE // len(l_at))
                for at in range(0, len(q_at), step):
                    q, r, n, k, v = hits([y[at : at + step] for _, y in usable], xs)
                    if len(q):
                        k = np.array([k for k, _ in usable])[k]
                        site, q = sites[q + at, k], q_at[q + at]
                        same = {"frag": pa.string(), "subset_size": pa.int32(), "aa_bucket": pa.string()}
                        fits = {"vdg_rmsd": (v, pa.float64()), "aa_perm_idx": (n, pa.int32()), "q_site_idx": (site[:, 0], pa.int32()), "q_cg_perm_idx": (site[:, 1], pa.int32())}
                        text, ints = pa.array(q), pa.array(l_at[r])

                        def column(c: str) -> pa.Array:
                            if c in same:
                                return pa.repeat(pa.scalar(key[_KEYS.index(c)], same[c]), len(q))  # noqa: B023
                            if c in fits:
                                return pa.array(*fits[c])  # noqa: B023
                            return block["text"][c].take(text) if c in block["text"] else other["ints"][c].take(ints)  # noqa: B023

                        yield pa.RecordBatch.from_arrays([column(c) for c in names], names=names)

    by = F.concat_ws("\0", "pdbfile", "sample", "bsr_combo"), F.col("vdg_index")
    return block_pairs(queries.select(*_KEYS, *_QUERY), lib, _KEYS, by, (_queries, _library), run, ", ".join(kinds))


def pair_match(queries: DataFrame, library: DataFrame, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """Matches of two-residue environments only."""
    return pose_match(queries.where("subset_size = 2"), library, threshold, columns=columns)


def validate_known_poses(queries: DataFrame, library: DataFrame, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """Every fit below the threshold at two decimal places, to hold known poses against the library."""
    return pose_match(queries, library, threshold, every_hit=True, strict=True, columns=columns)


def library_lookup(library: DataFrame, labels: list[str]) -> DataFrame:
    """Library rows of the bucket of these residues; GLY counts as backbone."""
    bucket = "_".join(sorted(BACKBONE_LABEL if a == "GLY" else a for a in labels))
    return library.where((F.col("subset_size") == len(labels)) & (F.col("aa_bucket") == bucket))


def accepted_matches(matches: DataFrame, cut: float, ignored: list[str], sizes: list[int], self_id: str = "pdbfile") -> DataFrame:
    """Matches that count for a score: within the cut, of wanted fragments and sizes, from other structures."""
    other = ~F.contains(F.col("struct_id"), F.col(self_id)) if self_id in matches.columns else F.lit(True)
    m = matches.where((F.col("vdg_rmsd") <= cut) & F.col("subset_size").isin(*sizes) & other)
    return m.where(~F.col("frag").isin(*ignored)) if ignored else m
