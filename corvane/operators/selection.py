"""Selections of atoms as column predicates; distances are joins (see corvane.operators.joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AA_CODES, BACKBONE_ATOMS, ION_RESIDUES, MODIFIED_RESIDUES, WATER_RESIDUES
from .joins import whole_residues, within

_PROTEIN = (*AA_CODES, "SEC", "PYL", "HID", "HIE", "HIP", "CYX", *MODIFIED_RESIDUES)


def is_protein() -> Column:
    return F.col("resname").isin(*_PROTEIN)


def is_backbone() -> Column:
    return is_protein() & F.col("name").isin(*BACKBONE_ATOMS)


def is_sidechain() -> Column:
    """Protein atoms beyond the backbone and the end's oxygen."""
    return is_protein() & ~F.col("name").isin(*BACKBONE_ATOMS, "OXT")


def is_water() -> Column:
    return F.col("resname").isin(*WATER_RESIDUES)


def is_ion() -> Column:
    return F.col("resname").isin(*ION_RESIDUES)


def is_hetero() -> Column:
    return F.col("record") == "HETATM"


def is_heavy() -> Column:
    return ~F.coalesce(F.col("element"), F.lit("")).isin("H", "D")


def compare(field: str, sign: str, value) -> Column:
    """field (resnum, resindex, occupancy, bfactor, serial, ...) against a number; a null field is false."""
    c = F.col(field)
    signs = {"=": c == value, "==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}
    if sign not in signs:
        raise ValueError(f"no comparison {sign}")
    return F.coalesce(signs[sign], F.lit(False))


def one_of(field: str, *values) -> Column:
    """field (name, resname, chain, seg, element, ...) among the values; a null field is false."""
    return F.coalesce(F.col(field).isin(*values), F.lit(False))


def single_residues(atoms: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the groups whose atoms are all of one segment, chain, residue number and name; others are ambiguous."""
    parts = ("seg", "chain", "resnum", "resname")
    good = atoms.groupBy(*group).agg(*(F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__{c}") for c in parts)).where(" and ".join(f"__{c} = 1" for c in parts))
    return atoms.join(good.select(*group), group, "left_semi")


def named_points(atoms: DataFrame, names: list[str], key: tuple[str, ...] = ("pdb_id", "seg", "chain", "resnum")) -> DataFrame:
    """points of each residue's atoms of these names, in their order; a name that isn't there just once fails the job."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) if c == "seg" else F.col(c) for c in key]
    each = atoms.where(F.col("name").isin(*names)).select(*keys, "name", F.array("x", "y", "z").alias("p"))
    g = each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "p")))).alias("m"), F.count("*").alias("n"), F.countDistinct("name").alias("d"))
    ok = (F.col("n") == len(names)) & (F.col("d") == len(names))
    what = F.concat(F.lit("residue "), F.concat_ws(":", *(F.col(c).cast("string") for c in key)), F.lit(f" doesn't have each of {', '.join(names)} once"))
    points = F.when(ok, F.array(*(F.col("m")[n] for n in names))).otherwise(F.raise_error(what).cast("array<array<double>>"))
    return g.select(*key, points.alias("points"))


def in_residue(seg: str | None, chain: str, resnum: int) -> Column:
    """One residue; an absent segment matches empty and null ones."""
    s = F.coalesce(F.col("seg"), F.lit("")) == (seg or "")
    return s & (F.col("chain") == chain) & (F.col("resnum") == resnum)


def around(atoms: DataFrame, centre: Column, radius: float, whole: bool = False) -> DataFrame:
    """Atoms within the radius of the atoms that centre selects, in their structure, these included;
    or the whole residues of such atoms."""
    near = within(atoms, atoms.where(centre).select("pdb_id", "x", "y", "z"), radius, ("pdb_id",), ("serial",))
    return whole_residues(atoms, near) if whole else near
