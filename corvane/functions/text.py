"""String functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CENTRE, FILENAME_CODES, GAP, JOB_NAME_CODES, LABEL_CODES, UNDESIRED_LANTHANIDES, UNDESIRED_METALS, UNDESIRED_NOBLE_GASES


def equal_places(a: Column, b: Column, first: int = 4) -> Column:
    """Positions, of the first few, at which two strings agree; the shorter one ends the count."""
    one = [F.when((F.length(a) >= i) & (F.length(b) >= i) & (F.substring(a, i, 1) == F.substring(b, i, 1)), 1).otherwise(0) for i in range(1, first + 1)]
    return reduce(lambda x, y: x + y, one)


def similar_ids(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two structure ids agree in at least so many of their first four places."""
    return equal_places(a, b) >= least


def _replaced(c: Column, codes: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), codes.items(), c)


def smiles_to_filename(c: Column) -> Column:
    return _replaced(c, FILENAME_CODES)


def smiles_to_job_name(c: Column) -> Column:
    return _replaced(c, JOB_NAME_CODES)


def safe_label(c: Column) -> Column:
    return _replaced(c, LABEL_CODES)


def bucket_name(labels: Column, ordered: bool = True) -> Column:
    """Labels joined by underscores, sorted unless told otherwise."""
    return F.array_join(F.array_sort(labels) if ordered else labels, "_")


def residue_label(keys: Column) -> Column:
    """seg:chain:resnum of each residue, joined by semicolons; keys: array of structs."""
    return F.array_join(F.transform(keys, lambda k: F.concat(F.coalesce(k["seg"], F.lit("")), F.lit(":"), F.coalesce(k["chain"], F.lit("")), F.lit(":"), k["resnum"].cast("string"))), ";")


def element_string(symbols: Column) -> Column:
    return F.array_join(F.array_sort(symbols), "")


def smiles_elements(smiles: Column) -> Column:
    """Element symbols in the order of a SMILES text, two-letter ones first."""
    return F.regexp_extract_all(smiles, F.lit("(Cl|Br|Si|Na|Li|[A-Z]|[cnosp])"), 1)


def strip_structure_suffix(c: Column) -> Column:
    """File name without directory and without .pdb, .cif and a following .gz."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.(pdb|cif|ent)(\.gz)?$", "")


def unbracket(smiles: Column) -> Column:
    """[X] to X for single letters."""
    return F.regexp_replace(smiles, r"\[([A-Za-z])\]", "$1")


def undesired_elements(smiles: Column) -> Column:
    """Substring test for metals, lanthanides, noble gases, and boron that isn't bromine."""
    names = "|".join([*UNDESIRED_METALS, *UNDESIRED_LANTHANIDES, *UNDESIRED_NOBLE_GASES])
    return smiles.rlike(f"({names})") | smiles.rlike("B(?!r)")


def percent_identity(a: Column, b: Column) -> Column:
    """Agreement of two aligned label lists in per cent: centres and gaps don't count; none left is 0."""
    both = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    pairs = F.filter(both, lambda z: ~z["p"].isin(CENTRE, GAP) & ~z["q"].isin(CENTRE, GAP))
    same = F.size(F.filter(pairs, lambda z: z["p"] == z["q"]))
    return F.coalesce(F.try_divide(F.lit(100.0) * same, F.size(pairs)), F.lit(0.0))


def match_file_rmsd(c: Column) -> Column:
    """The number after the last underscore of a match file's name, without its suffix."""
    return F.regexp_replace(F.element_at(F.split(c, "_"), -1), r"\.(pdb|cif)(\.gz)?$", "").cast("double")


def match_file_size(c: Column) -> Column:
    """Contacting residues told by a match file's name: 9 underscores 2, 5 underscores 1, else an error."""
    n = F.size(F.split(c, "_")) - 1
    return F.when(n == 9, 2).when(n == 5, 1).otherwise(F.raise_error(F.concat(F.lit("unexpected match file name: "), c)).cast("int"))


def elapsed(seconds: Column) -> Column:
    """struct<h, m, s> of a number of seconds."""
    return F.struct(F.floor(seconds / 3600).cast("int").alias("h"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int").alias("m"), F.bround(F.pmod(seconds, F.lit(60)), 2).alias("s"))


def pseudo_ligand(resname: Column, codes) -> Column:
    """Four-letter residue names that begin with an amino acid's code."""
    return (F.length(resname) == 4) & F.substring(resname, 1, 3).isin(*codes)
