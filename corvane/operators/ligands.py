"""Ligands inside structures: graphs from atoms, placings of fragments, pose queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AA_CODES, ION_RESIDUES, MODIFIED_RESIDUES, WATER_RESIDUES
from ..functions import chem

#: Covalent radii in angstrom; bonds are shorter than their sum and 0.4.
COVALENT = {"H": 0.31, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "P": 1.07, "S": 1.05, "Cl": 1.02, "Br": 1.20, "I": 1.39}


def is_ligand(record: Column, resname: Column) -> Column:
    """Hetero atoms that are no water, ion or modified residue."""
    return (record == "HETATM") & ~resname.isin(*WATER_RESIDUES, *ION_RESIDUES, *MODIFIED_RESIDUES)


def mol_of(symbols: list[str], coords: np.ndarray) -> chem.Mol:
    """A graph of single bonds between atoms that are near enough."""
    r = np.array([COVALENT.get(s, 1.5) for s in symbols])
    d = np.linalg.norm(coords[:, None] - coords[None], axis=2)
    i, j = np.nonzero(np.triu((d < r[:, None] + r[None] + 0.4) & (d > 0.4), 1))
    return chem.Mol([chem.Atom(s) for s in symbols], [(int(a), int(b), chem.SINGLE) for a, b in zip(i, j)])


def match_points(molecules: DataFrame, pattern: str) -> DataFrame:
    """name, match_no, atoms and points of every place of a pattern in molecules (name, symbols, coords, bonds).

    One match for each set of atoms. Bond order 4 is aromatic; molecules without a graph have none.
    """
    kind = "name string, match_no int, atoms array<int>, points array<array<double>>"

    def run(parts):
        want = chem.parse_smiles(pattern)
        for p in parts:
            rows = []
            for name, symbols, coords, bonds in zip(p["name"], p["symbols"], p["coords"], p["bonds"]):
                if symbols is None or coords is None:
                    continue
                order = [(b["i"], b["j"], chem.AROMATIC if b["bond_order"] == 4 else float(b["bond_order"])) for b in (bonds if bonds is not None else [])]
                ring = {k for i, j, o in order if o == chem.AROMATIC for k in (i, j)}
                mol = chem.Mol([chem.Atom(x, i in ring) for i, x in enumerate(symbols)], order)
                for n, m in enumerate(chem.matches(mol, want)):
                    rows.append((name, n, list(m), [list(map(float, coords[i])) for i in m]))
            yield pd.DataFrame(rows, columns=["name", "match_no", "atoms", "points"])

    return molecules.select("name", "symbols", "coords", "bonds").mapInPandas(run, kind)


PLACINGS = "pdb_id string, seg string, chain string, resnum int, resname string, frag string, canonical string, site int, perm int, names array<string>, coords array<array<double>>"


def fragment_placings(atoms: DataFrame, templates: DataFrame, radius: int = 2, names: tuple[str, ...] | None = None) -> DataFrame:
    """Every placing of every fragment of each structure's ligand, in all fitting atom orders.

    templates: resname and smiles, the first of a name counts; its bond orders and charges are laid
    on the atoms. A ligand that its template doesn't fit has no fragments.
    """
    from .joins import lookup_first

    lig = atoms.where(is_ligand(F.col("record"), F.col("resname")) & ~F.col("element").isin("H", "D") & ~F.col("resname").isin(*AA_CODES))
    lig = lookup_first(lig, templates.withColumn("__o", F.monotonically_increasing_id()), "resname", "__o").drop("__o")
    key = ["pdb_id", "seg", "chain", "resnum", "resname"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("serial").drop_duplicates("name")
        xyz = p[["x", "y", "z"]].to_numpy(float)
        symbols = [s.capitalize() for s in p["element"]]
        rows = []
        try:
            template = chem.parse_smiles(p["smiles"].iloc[0])
            mol = chem.with_template_orders(mol_of(symbols, xyz), template.part(template.heavy()))
        except chem.SmilesError:
            return pd.DataFrame(rows, columns=[x.split()[0] for x in PLACINGS.split(", ")])
        count: dict[tuple, int] = {}
        for f in chem.fragments(mol, radius):
            perm = count[f.smiles, f.site] = count.get((f.smiles, f.site), -1) + 1
            at = list(f.atoms)
            rows.append((*p[key].iloc[0], f.smiles, f.key, f.site, perm, [p["name"].iloc[i] for i in at], xyz[at].tolist()))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PLACINGS.split(", ")])

    return lig.select(*key, "serial", "name", "element", "x", "y", "z", "smiles").groupBy(*key).applyInPandas(run, PLACINGS)


def pose_queries(placings: DataFrame, combos: DataFrame, library_names: DataFrame) -> DataFrame:
    """Queries for pose_match: each pose's fragments that the library knows, with each combination.

    library_names: name, canonical. combos: as binding_site_combos gives them, of the solved
    structure or of each pose.
    """
    known = placings.join(library_names.groupBy("canonical").agg(F.min("name").alias("library")), "canonical")
    sites = known.groupBy("pdb_id", "library").agg(F.array_sort(F.collect_list(F.struct("site", "perm", F.col("coords").alias("c")))).alias("v"))
    j = sites.join(combos, "pdb_id")
    return j.select(
        F.col("pdb_id").alias("pdbfile"), F.col("pdb_id").alias("sample"), F.col("pdb_id").alias("struct_id"), F.col("library").alias("frag"), "subset_size", "bsr_combo", "aa_bucket", "labels", "q_bb",
        F.transform("v", lambda x: x["c"]).alias("q_cg"), F.transform("v", lambda x: F.struct(x["site"].alias("site"), x["perm"].alias("perm"))).alias("q_sites"),
    )


def least_matching(cost: np.ndarray) -> float:
    """Least total of a square cost matrix with one entry from each row and column.

    Shortest augmenting paths with potentials (Hungarian), n**3 steps.
    """
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)  # rows count from 1; column 0 holds the row being placed
    for row in range(1, n + 1):
        row_of[0], col = row, 0
        least, via, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while row_of[col]:
            done[col] = True
            i = row_of[col]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], via[1:][better] = slack[better], col
            col = int(np.where(done, np.inf, least).argmin())
            step = least[col]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
        while col:
            row_of[col] = row_of[via[col]]
            col = via[col]
    return float(cost[row_of[1:] - 1, np.arange(n)].sum())


def ligand_rmsd(poses: DataFrame, solved: DataFrame) -> DataFrame:
    """In-place RMSD of each pose's ligand to the solved one over orders of symmetric atoms.

    Both: pdb_id, smiles, names, coords (in the order of the SMILES); solved is one row a smiles.
    The least over all orders within the symmetry classes: in place, each class's best order is an
    assignment on squared distances.
    """
    j = poses.join(solved.select("smiles", F.col("coords").alias("ref")), "smiles")

    def run(parts):
        for p in parts:
            out = []
            for pdb, s, c, r in zip(p["pdb_id"], p["smiles"], p["coords"], p["ref"]):
                x, y = (np.array([np.asarray(v, float) for v in k]) for k in (c, r))
                classes = np.array(chem.symmetry_classes(chem.parse_smiles(s)))
                if not len(classes) == len(x) == len(y):
                    raise ValueError(f"{pdb}: {len(x)} and {len(y)} atoms, {len(classes)} in {s}")
                total = 0.0
                for k in np.unique(classes):
                    at = np.flatnonzero(classes == k)
                    cost = ((x[at][:, None] - y[at][None]) ** 2).sum(2)
                    total += least_matching(cost) if np.isfinite(cost).all() else np.nan
                out.append((pdb, float(np.sqrt(total / len(x))) if len(x) else np.nan))
            yield pd.DataFrame(out, columns=["pdb_id", "rmsd"])

    return j.select("pdb_id", "smiles", "coords", "ref").mapInPandas(run, "pdb_id string, rmsd double")


def structures_of_ligands(ligands: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ligands with the structures that hold them, ligands that no structure holds); index: lig_id, pdb_id."""
    return ligands.join(index, "lig_id"), ligands.join(index, "lig_id", "left_anti")
