"""Fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Heavy atoms of each amino acid.
AA_HEAVY_ATOMS = {
    "ALA": 5, "ARG": 11, "ASN": 8, "ASP": 8, "CYS": 6, "GLN": 9, "GLU": 9, "GLY": 4, "HIS": 10, "ILE": 8,
    "LEU": 8, "LYS": 9, "MET": 8, "PHE": 11, "PRO": 7, "SER": 6, "THR": 7, "TRP": 14, "TYR": 12, "VAL": 7,
}
# Background frequency of each amino acid.
AA_BACKGROUND = {
    "ALA": 0.08733094390532901, "ARG": 0.05087485521087214, "ASN": 0.041897950447092915, "ASP": 0.05879308405096171,
    "CYS": 0.012710544745734504, "GLN": 0.03609622691998023, "GLU": 0.06630531499164175, "GLY": 0.07549944048308671,
    "HIS": 0.024245591820242822, "ILE": 0.05869006081418494, "LEU": 0.09261670471415538, "LYS": 0.05449929225491284,
    "MET": 0.019573399146303915, "PHE": 0.04036970189037058, "PRO": 0.04583966858516758, "SER": 0.05872967862421906,
    "THR": 0.05488167184449434, "TRP": 0.013705138015159568, "TYR": 0.03489372480131626, "VAL": 0.07244700673477375,
}
# Van der Waals radii in angstrom.
VDW_RADII = {"C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98}
# Element pairs that may form hydrogen bonds.
HBOND_PAIRS = (("N", "O"), ("O", "O"), ("N", "N"))
# Residues and atom names counted as aromatic.
AROMATIC_RESIDUES = ("PHE", "TYR", "TRP")
AROMATIC_ATOMS = ("CG", "CD2", "CD1", "CE1", "CE2", "CH2", "NE1", "CE3", "CZ3", "CZ2", "CZ")
# Backbone atom names; water and ion residue names; modified residues that are no ligands.
BACKBONE_ATOMS = ("N", "CA", "C", "O")
FRAME_ATOMS = ("N", "CA", "C")
WATER_RESIDUES = ("HOH", "WAT", "DOD", "TIP3", "H2O", "SOL")
ION_RESIDUES = ("NA", "CL", "K", "MG", "CA", "ZN", "MN", "FE", "FE2", "CU", "CD", "NI", "CO", "HG", "BR", "IOD", "CS", "RB", "SR", "BA")
MODIFIED_RESIDUES = ("SEP", "TPO", "MSE")
# Elements whose presence in a SMILES text rules a ligand out.
UNDESIRED_METALS = (
    "Be", "Pt", "Ru", "Ir", "Fe", "Zn", "Mg", "Cu", "Sn", "Zr", "Pb", "Ga", "Hg", "Pd", "Si", "Mo", "W", "Se", "Mn", "Ti", "Y", "V", "Ni", "Rh", "Te", "Au", "Ag", "Co", "Sb", "Re", "As", "Cd", "Hf", "Na", "Ca", "Os", "Cr", "In", "Al", "U", "K", "se",
)
UNDESIRED_LANTHANIDES = (
    "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu",
)
UNDESIRED_NOBLE_GASES = (
    "He", "Ne", "Ar", "Kr", "Xe", "Rn",
)
# Numeric code of a bond's kind; anything else is 0.
BOND_CODES = {"SINGLE": 1, "DOUBLE": 2, "TRIPLE": 3, "AROMATIC": 4}
# Signs replaced in file names, job names and labels.
FILENAME_CODES = {"/": "_fs_", "\\": "_bs_"}
JOB_NAME_CODES = {"#": "_tp_"}
LABEL_CODES = {"/": "_", " ": "_", "#": "hash"}

AA_CODES = tuple(sorted(AA_HEAVY_ATOMS))
BACKBONE_LABEL, CENTRE, GAP = "bb", "vdm", "X"


def mean_aa_size(weighted: bool) -> float:
    """Mean heavy atoms of an amino acid, plain or weighted by background frequency."""
    if weighted:
        return sum(AA_BACKGROUND[a] * AA_HEAVY_ATOMS[a] for a in AA_CODES)
    return sum(AA_HEAVY_ATOMS.values()) / len(AA_HEAVY_ATOMS)


def aa_reference(spark: SparkSession) -> DataFrame:
    """aa, heavy_atoms, bg_freq: 20 rows."""
    return spark.createDataFrame([(a, AA_HEAVY_ATOMS[a], AA_BACKGROUND[a]) for a in AA_CODES], "aa string, heavy_atoms int, bg_freq double")


def vdw_reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(VDW_RADII.items()), "element string, radius double")
