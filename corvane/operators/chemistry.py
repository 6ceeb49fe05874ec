"""Chemistry over tables of ligands: parsing, filters, fragments and their dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..functions import text as C
from ..functions.udf import arrow_udf
from .windows import ordered_by_members

MOL = "struct<symbols: array<string>, aromatic: array<boolean>, charges: array<int>, bonds: array<struct<i: int, j: int, bond_order: double>>, pairs: array<string>, error: string>"


@arrow_udf(MOL)
def molecule(smiles: pd.Series) -> pd.DataFrame:
    """The parsed graph of each SMILES; error tells why there is none."""
    rows = []
    for s in smiles:
        try:
            m = chem.parse_smiles(s or "")
            rows.append(([a.symbol for a in m.atoms], [a.aromatic for a in m.atoms], [a.charge for a in m.atoms], [{"i": i, "j": j, "bond_order": o} for i, j, o in m.bonds], sorted(chem.element_pairs(m)), None))
        except (chem.SmilesError, IndexError) as e:
            rows.append((None, None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["symbols", "aromatic", "charges", "bonds", "pairs", "error"])


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            try:
                out.append(f(x or ""))
            except (chem.SmilesError, IndexError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


canonical_key = arrow_udf("string")(_each(lambda s: chem.canonical_key(chem.parse_smiles(s))))
canonical_smiles = arrow_udf("string")(_each(lambda s: chem.write_smiles(chem.parse_smiles(s))))
symmetry_string = arrow_udf("string")(_each(chem.symmetry_string))
strip_hydrogens = arrow_udf("string")(_each(chem.strip_hydrogens))


def has_substructure(pattern: str):
    return arrow_udf("boolean")(_each(lambda s: chem.has_substructure(chem.parse_smiles(s), pattern)))


def with_status(ligands: DataFrame) -> DataFrame:
    """ligands with mol and status: undesired, unparsable, not organic or ok. The cheap text test runs first."""
    bad = C.undesired_elements(F.col("smiles"))
    m = ligands.withColumn("undesired", F.coalesce(bad, F.lit(True))).withColumn("mol", molecule(F.when(~F.col("undesired"), F.col("smiles"))))
    organic = F.arrays_overlap("mol.symbols", F.array(F.lit("C"), F.lit("O"), F.lit("N")))
    return m.withColumn("status", F.when(F.col("undesired"), "undesired").when(F.col("mol.error").isNotNull(), "unparsable").when(~organic, "not organic").otherwise("ok")).drop("undesired")


def matching_molecules(ligands: DataFrame, pattern: str) -> DataFrame:
    """Ligands that hold the pattern. Element pairs are compared before any graph is searched."""
    wanted = F.array(*(F.lit(p) for p in sorted(chem.element_pairs(chem.parse_smiles(pattern))))).cast("array<string>")
    m = with_status(ligands).where("status = 'ok'")
    return m.where(F.size(F.array_except(wanted, "mol.pairs")) == 0).where(has_substructure(pattern)("smiles")).drop("mol", "status")


FRAGMENTS = "lig_id string, elements_str string, smiles string, canonical string, site int, atoms array<int>"


def ligand_fragments(ligands: DataFrame, radius: int = 2, least: int = 4, most: int = 5) -> DataFrame:
    """Every fragment of every usable ligand, in every fitting order of atoms.

    Each different SMILES is parsed once, on all cores whatever files the ligands lie in, and
    its fragments are joined to the ligands that have it.
    """
    known = ligands.select("smiles").where(F.col("smiles").isNotNull() & ~C.undesired_elements(F.col("smiles"))).distinct()
    known = known.repartition(int(ligands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "smiles")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for s in p["smiles"]:
                try:
                    m = chem.parse_smiles(s)
                except (chem.SmilesError, IndexError):
                    continue
                if {a.symbol for a in m.atoms} & {"C", "O", "N"}:
                    rows.append((s, [(f.elements, f.smiles, f.key, f.site, list(f.atoms)) for f in chem.fragments(m, radius, least, most)]))
            yield pd.DataFrame(rows, columns=["source", "fragments"])

    found = known.mapInPandas(run, "source string, fragments array<struct<elements_str: string, smiles: string, canonical: string, site: int, atoms: array<int>>>")
    return ligands.select("lig_id", F.col("smiles").alias("source")).join(found, "source").select("lig_id", F.explode("fragments").alias("f")).select("lig_id", "f.*")


def with_keys(ligands: DataFrame) -> DataFrame:
    """ligands with symmetry and canonical of their SMILES; each different one is worked out once, on all cores."""
    known = ligands.select("smiles").distinct().repartition(int(ligands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "smiles")
    return ligands.join(known.select("smiles", symmetry_string("smiles").alias("symmetry"), canonical_key("smiles").alias("canonical")), "smiles", "left")


def fragment_dictionary(fragments: DataFrame) -> DataFrame:
    """elements_str, smiles, lig_id: each fragment once for each ligand."""
    return fragments.select("elements_str", "smiles", "canonical", "lig_id").distinct()


def qualifying_fragments(dictionary: DataFrame, least: int = 80, most_atoms: int = 5) -> DataFrame:
    """Fragments of enough ligands and few enough atoms; place: most ligands first in their element group."""
    n = dictionary.groupBy("elements_str", "smiles", "canonical").agg(F.countDistinct("lig_id").alias("ligands")).withColumn("atoms", F.size(C.smiles_elements(F.col("smiles"))))
    good = n.where((F.col("ligands") >= least) & (F.col("atoms") <= most_atoms))
    return ordered_by_members(good, "elements_str", "ligands", "smiles").withColumn("symmetry", symmetry_string("smiles"))


def bond_code(order):
    """Numeric code of a bond order: single 1, double 2, triple 3, aromatic 4, else 0."""
    return F.when(order == 1.5, 4).when(order.isin(1.0, 2.0, 3.0), order.cast("int")).otherwise(0)


ATOM_FEATURES = "lig_id string, atom int, atomic_num int, hybridization int, arom boolean, in_ring boolean, total_degree int, degree_noH int, num_Hs int"


def atom_features(ligands: DataFrame) -> DataFrame:
    """One row of graph features per ligand atom."""

    def run(parts):
        for p in parts:
            rows = []
            for lig, s in zip(p["lig_id"], p["smiles"]):
                m = chem.parse_smiles(s)
                rows += [(lig, i, *chem.atom_features(m, i).values()) for i in range(len(m.atoms))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ATOM_FEATURES.split(", ")])

    return with_status(ligands).where("status = 'ok'").select("lig_id", "smiles").mapInPandas(run, ATOM_FEATURES)
