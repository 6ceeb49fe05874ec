"""The contact library as partitioned Parquet, and the small text outputs of a run."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def write_library(library: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitions by fragment, size and bucket; one shuffle on them, so few files each.

    The shuffle is a rebalancing one: adaptive execution splits a bucket that is too large for a task.
    """
    key = ["frag", "subset_size", "aa_bucket"]
    library.hint("rebalance", *key).write.mode(mode).partitionBy(*key).parquet(path)


def read_library(spark: SparkSession, path: str, frag: str | None = None, size: int | None = None, bucket: str | None = None) -> DataFrame:
    """The library, pruned to partitions; a bucket that isn't there is no rows."""
    df = spark.read.schema(schemas.NR_VDGS).parquet(path)
    for c, v in (("frag", frag), ("subset_size", size), ("aa_bucket", bucket)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def read_records(spark: SparkSession, path) -> DataFrame:
    """Contact records as JSON lines, plain or .gz, with an explicit schema."""
    return spark.read.schema(schemas.VDG_RECORDS).json(path)


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines by bucket; writing again replaces, it never appends."""
    records.write.mode(mode).option("compression", "gzip").partitionBy("frag", "subset_size", "aa_bucket").json(path)


def read_networks(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.NETWORKS).json(path)


def unfinished(structures: DataFrame, networks: DataFrame, key: str = "pdb_file") -> DataFrame:
    """Structures without networks yet: what a stopped run has still to do."""
    return structures.join(networks.select(key).distinct(), key, "left_anti")


def append_networks(networks: DataFrame, path: str) -> None:
    """Networks of further structures; a structure's old ones are replaced, so a repeated run adds nothing twice.

    One JSON folder for each structure; only those of the given ones are written.
    """
    named = networks.withColumn("structure", F.col("pdb_file"))
    named.repartition("structure").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("structure").json(path)


def read_fragment_dictionary(spark: SparkSession, path) -> DataFrame:
    """The table elements_str, smiles, lig_id of a fragment run, as Parquet."""
    return spark.read.schema(schemas.FRAG_LIGANDS).parquet(path)


def write_group_table(table: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A group contact table as Parquet or CSV."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"no format {kind}")
    w = table.write.mode(mode)
    w.parquet(path) if kind == "parquet" else w.option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, order: str, mode: str = "overwrite") -> None:
    """The column value as one text file in order; for outputs of bounded size (grids, name lists)."""
    df.orderBy(order).select("value").coalesce(1).write.mode(mode).text(path)


def flattened(networks: DataFrame) -> DataFrame:
    """One row for each network and residue, keys as text."""
    return networks.select("pdb_file", F.concat_ws(" ", "lig.seg", "lig.chain", F.col("lig.resnum").cast("string"), "lig.resname").alias("lig"), F.explode("residues").alias("r")).select("pdb_file", "lig", F.concat_ws(" ", "r.seg", "r.chain", F.col("r.resnum").cast("string"), "r.resname").alias("residue"))


@dataclass
class LibraryJob:
    """Parameters of a library run."""

    frag: str
    out_dir: str
    symmetry_classes: list[int] | None = None
    identity: float = 0.40
    flank: int = 2
    sizes: tuple[int, ...] = (1, 2)
    most_structures: int = 2500


class Settings:
    """Made from a dictionary or a YAML text; names that a job doesn't know are an error."""

    @classmethod
    def from_dict(cls, d: dict):
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(d) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: v for k, v in d.items() if v is not None})

    @classmethod
    def from_yaml(cls, text: str):
        """Needs a YAML library, which isn't otherwise used."""
        import yaml

        return cls.from_dict(yaml.safe_load(text))


@dataclass
class RerankJob(Settings):
    """Parameters of a pose ranking run."""

    library_dir: str
    query_pdbs_dir: str
    outdir: str
    lig_smiles: str
    solved_struct_path: str = ""
    rmsd_threshold: float = 0.7
    frags_to_exclude: list[str] = field(default_factory=list)
    frags_to_include: list[str] = field(default_factory=list)
    query_pdbs: list[str] = field(default_factory=list)


@dataclass
class PoseValidationJob(Settings):
    """Parameters of holding known poses against the library."""

    library_dir: str
    query_pdbs_dir: str
    outdir: str
    rmsd_threshold: float = 0.7
    query_pdbs: list[str] = field(default_factory=list)


@dataclass
class FragmentJob(Settings):
    """Parameters of a fragment dictionary and its list of SMILES."""

    ligands: str
    outdir: str
    radius: int = 2
    least_atoms: int = 4
    most_atoms: int = 5
    least_ligands: int = 80


@dataclass
class GroupTableJob(Settings):
    """Parameters of a table of a group's contacts."""

    pattern: str
    contacts: str
    structures: str
    out: str
    allowed_types: list[str] = field(default_factory=list)


def job_script(template: str, values: dict[str, object]) -> str:
    """A text with $name placeholders filled; unknown ones are an error."""
    return Template(template).substitute({k: str(v) for k, v in values.items()})
