"""Readers and writers of structures, ligands, contacts and environments.

Everything goes through Spark's readers and writers, so paths can lie in any store that Spark
reaches. Fixed-column text is cut with substrings, not parsed in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip_structure_suffix


def _file() -> Column:
    return F.col("_metadata.file_path")


def _text(spark: SparkSession, path, **options) -> DataFrame:
    return spark.read.options(**options).text(path).select("value", _file().alias("path"))


def read_pdb(spark: SparkSession, path) -> DataFrame:
    """ATOM and HETATM lines (plain or .gz) as schemas.ATOMS; only the first model.

    pdb_id is the file name without its suffix. Residue indices follow the order of atoms.
    """
    lines = _text(spark, path).withColumn("at", F.monotonically_increasing_id())
    models = lines.where(F.substring("value", 1, 6) == "ENDMDL").groupBy("path").agg(F.min("at").alias("end"))
    a = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")).join(models, "path", "left").where("end is null or at < end")
    cut = lambda i, n: F.trim(F.substring("value", i, n))
    num = lambda i, n, t: F.when(cut(i, n) != "", F.expr(f"try_cast(trim(substring(value, {i}, {n})) as {t})"))
    atoms = a.select(
        strip_structure_suffix(F.col("path")).alias("pdb_id"), num(7, 5, "int").alias("serial"), cut(1, 6).alias("record"), cut(13, 4).alias("name"), cut(18, 4).alias("resname"), cut(22, 1).alias("chain"), cut(73, 4).alias("seg"), num(23, 4, "int").alias("resnum"),
        F.when(cut(77, 2) != "", cut(77, 2)).otherwise(F.regexp_extract(cut(13, 4), "([A-Za-z])", 1)).alias("element"), num(55, 6, "double").alias("occupancy"), num(61, 6, "double").alias("bfactor"), num(31, 8, "double").alias("x"), num(39, 8, "double").alias("y"), num(47, 8, "double").alias("z"), "at",
    )
    return _indexed(atoms, "at")


def _indexed(atoms: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("pdb_id").orderBy(order)
    key = F.struct("seg", "chain", "resnum", "resname")
    new = F.coalesce(~key.eqNullSafe(F.lag(key).over(w)), F.lit(True)).cast("int")
    out = atoms.withColumn("__new", new).withColumn("resindex", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    out = out.withColumn("role", F.lit("other")).withColumn("cg_index", F.lit(None).cast("int"))
    return out.select(*(F.col(f.strip().split()[0]) for f in schemas.ATOMS.split(",")))


def read_bonds(spark: SparkSession, path) -> DataFrame:
    """CONECT lines as pairs of serials, each once in the order written."""
    v = _text(spark, path).where(F.substring("value", 1, 6) == "CONECT")
    others = F.filter(F.array(*(F.expr(f"try_cast(trim(substring(value, {i}, 5)) as int)") for i in (12, 17, 22, 27))), lambda x: x.isNotNull())
    return v.select(strip_structure_suffix(F.col("path")).alias("pdb_id"), F.expr("try_cast(trim(substring(value, 7, 5)) as int)").alias("serial1"), F.explode(others).alias("serial2")).distinct()


def _cif_tokens(text: str) -> Iterator[str]:
    lines = iter(text.split("\n"))
    for line in lines:
        if line.startswith(";"):
            body = [line[1:]]
            for line in lines:
                if line.startswith(";"):
                    break
                body.append(line)
            yield "\n".join(body)
            continue
        i = 0
        while i < len(line):
            c = line[i]
            if c in " \t\r":
                i += 1
            elif c == "#":
                break
            elif c in "'\"":
                j = i + 1
                while j < len(line) and not (line[j] == c and (j + 1 == len(line) or line[j + 1] in " \t\r")):
                    j += 1
                yield line[i + 1 : j]
                i = j + 1
            else:
                j = i
                while j < len(line) and line[j] not in " \t\r":
                    j += 1
                yield line[i:j]
                i = j


def cif_atoms(text: str) -> list[dict]:
    """Rows of the atom_site loop of an mmCIF text."""
    tokens, names, rows = iter(_cif_tokens(text)), [], []
    for t in tokens:
        if t == "loop_":
            names, values = [], []
            for t in tokens:
                if t.startswith("_") and not values:
                    names.append(t)
                elif t.startswith(("_", "loop_", "data_")) and len(values) % max(len(names), 1) == 0:
                    break
                else:
                    values.append(t)
            if names and names[0].startswith("_atom_site."):
                n = len(names)
                keys = [x.split(".")[1] for x in names]
                rows += [dict(zip(keys, values[i : i + n])) for i in range(0, len(values) - n + 1, n)]
                break
    return rows


def read_cif(spark: SparkSession, path) -> DataFrame:
    """mmCIF atom sites (first model, plain or .gz) as schemas.ATOMS; author numbering."""
    raw = "pdb_id string, at long, serial int, record string, name string, resname string, chain string, seg string, resnum int, element string, occupancy double, bfactor double, x double, y double, z double"

    def run(parts):
        import gzip

        for p in parts:
            for name, content in zip(p["pdb_id"], p["content"]):
                text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")
                out = []
                for i, r in enumerate(cif_atoms(text)):
                    if r.get("pdbx_PDB_model_num", "1") not in ("1", "?", "."):
                        continue
                    g = lambda *ks: next((r[k] for k in ks if r.get(k, ".") not in (".", "?")), None)
                    f = lambda k: float(g(k)) if g(k) is not None else None
                    no = g("auth_seq_id", "label_seq_id")
                    out.append((name, i, int(g("id") or i), g("group_PDB"), g("auth_atom_id", "label_atom_id"), g("auth_comp_id", "label_comp_id"), g("auth_asym_id", "label_asym_id"), "", int(no) if no else None, g("type_symbol"), f("occupancy"), f("B_iso_or_equiv"), f("Cartn_x"), f("Cartn_y"), f("Cartn_z")))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in raw.split(", ")]).astype({"serial": "Int32", "resnum": "Int32"})

    files = spark.read.format("binaryFile").load(path).select(strip_structure_suffix(F.col("path")).alias("pdb_id"), "content")
    return _indexed(files.mapInPandas(run, raw), "at")


def write_pdb(atoms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per structure with PDB lines in the order of serials."""
    name = F.when(F.length("name") >= 4, F.substring("name", 1, 4)).otherwise(F.concat(F.lit(" "), F.rpad("name", 3, " ")))
    line = F.format_string(
        "%-6s%5d %s %-4s%s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s%2s", "record", F.pmod(F.col("serial"), F.lit(100000)), name, "resname", F.rpad(F.coalesce("chain", F.lit("")), 1, " "), "resnum", "x", "y", "z",
        F.coalesce("occupancy", F.lit(1.0)), F.coalesce("bfactor", F.lit(0.0)), F.coalesce("seg", F.lit("")), F.coalesce("element", F.lit("")),
    )
    rows = atoms.select("pdb_id", "serial", line.alias("value"))
    rows.repartition("pdb_id").sortWithinPartitions("pdb_id", "serial").select("pdb_id", "value").write.mode(mode).partitionBy("pdb_id").text(path)


def read_ligands(spark: SparkSession, path) -> DataFrame:
    """Tab separated SMILES, id and optional name; rows of another width are an error where read."""
    v = F.split("value", "\t")
    ok = F.size(v).between(2, 3)
    lines = spark.read.text(path).where("trim(value) != ''")
    unquoted = lambda c: F.regexp_replace(c, '^"(.*)"$', "$1")
    row = F.when(ok, F.struct(unquoted(v[0]).alias("smiles"), unquoted(v[1]).alias("lig_id"), unquoted(F.try_element_at(v, F.lit(3))).alias("name"))).otherwise(F.raise_error(F.concat(F.lit("ligand line of "), F.size(v).cast("string"), F.lit(" columns"))).cast("struct<smiles: string, lig_id: string, name: string>"))
    return lines.select(row.alias("r")).select("r.*")


def _sdf_record(text: str) -> tuple | None:
    """(name, symbols, coords, bonds) of a V2000 or V3000 record; None of one without a counts line."""
    lines = text.split("\n")
    head = next((i for i, x in enumerate(lines) if "V2000" in x or "V3000" in x), None)
    if head is None:
        return None
    name = lines[head - 3].strip() if head >= 3 else ""
    if "V3000" in lines[head]:
        body = "\n".join(lines[head:]).replace("-\nM  V30 ", "").split("\n")
        rows = [x[6:].strip() for x in body if x.startswith("M  V30")]
        part = lambda k: [x.split() for x in rows[rows.index(f"BEGIN {k}") + 1 : rows.index(f"END {k}")]] if f"BEGIN {k}" in rows else []
        atoms, bonds = part("ATOM"), part("BOND")
        at = {a[0]: i for i, a in enumerate(atoms)}
        return name, [a[1] for a in atoms], [[float(v) for v in a[2:5]] for a in atoms], [{"i": at[b[2]], "j": at[b[3]], "bond_order": int(b[1])} for b in bonds]
    n, m = int(lines[head][:3]), int(lines[head][3:6])
    atoms, bonds = [x.split() for x in lines[head + 1 : head + 1 + n]], lines[head + 1 + n : head + 1 + n + m]
    if len(atoms) < n or len(bonds) < m:
        raise ValueError("the record ends early")
    return name, [a[3] for a in atoms], [[float(v) for v in a[:3]] for a in atoms], [{"i": int(b[:3]) - 1, "j": int(b[3:6]) - 1, "bond_order": int(b[6:9])} for b in bonds]


def read_sdf(spark: SparkSession, path) -> DataFrame:
    """name, symbols, coords and bonds of each record of SD files (V2000 and V3000).

    error: why a malformed record has none of these; such a record doesn't stop the others.
    """
    kind = "name string, symbols array<string>, coords array<array<double>>, bonds array<struct<i: int, j: int, bond_order: int>>, path string, error string"

    def run(parts):
        for p in parts:
            rows = []
            for text, file in zip(p["value"], p["path"]):
                try:
                    if found := _sdf_record(text):
                        rows.append((*found, file, None))
                except (ValueError, IndexError, KeyError) as e:
                    rows.append((None, None, None, None, file, str(e)))
            yield pd.DataFrame(rows, columns=["name", "symbols", "coords", "bonds", "path", "error"])

    return _text(spark, path, lineSep="$$$$\n").mapInPandas(run, kind)


def read_environments(spark: SparkSession, path: str) -> DataFrame:
    """Environment lines of subdir/file: a list of tuples, the group first, as schemas.ENVIRONMENTS.

    (subdir, file, line_no) is the order that order-dependent operators need; lines are numbered
    within their file. Only files that have a fingerprints file beside them count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ready = files.where(F.col("path").endswith("_fingerprints.npy")).select(F.regexp_replace("path", "_fingerprints.npy$", "_environments.txt").alias("path"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.decode(F.encode(_file(), "utf-8"), "utf-8").alias("path")).where(F.col("path").endswith("_environments.txt"))
    lines = lines.join(ready, "path", "left_semi").select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    tuples = F.regexp_extract_all("line", F.lit(r"\(([^()]*)\)"), 1)
    parts = F.transform(tuples, lambda t: F.transform(F.split(t, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")))
    g = lines.withColumn("p", parts).where(F.size("p") > 0)
    res = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda r: F.struct(F.get(r, F.lit(0)).alias("biounit"), F.get(r, F.lit(1)).alias("seg"), F.get(r, F.lit(2)).alias("chain"), F.get(r, F.lit(3)).cast("int").alias("resnum")))
    one = F.get("p", F.lit(0))
    return g.select(
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("subdir"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("line_no").cast("int").alias("line_no"), F.get(one, F.lit(0)).alias("biounit"),
        F.struct(F.get(one, F.lit(1)).alias("seg"), F.get(one, F.lit(2)).alias("chain"), F.get(one, F.lit(3)).cast("int").alias("resnum"), F.try_element_at(one, F.lit(5)).cast("int").alias("match_no")).alias("cg"), res.alias("residues"),
    )


def read_contacts(spark: SparkSession, path) -> DataFrame:
    """Contact tables as Parquet with the columns of schemas.CONTACTS."""
    return spark.read.schema(schemas.CONTACTS).parquet(path)


def layout_problems(spark: SparkSession, path: str) -> DataFrame:
    """Files that don't lie in the subfolder named by the two inner characters of their four-letter id."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("subdir"), strip_structure_suffix(F.col("path")).alias("id"))
    return f.where((F.length("id") < 4) | (F.lower(F.substring("id", 2, 2)) != F.lower("subdir")) | (F.length("subdir") != 2))


def mirrored(atoms: DataFrame) -> DataFrame:
    """atoms with the subfolder of a mirrored layout, to be written with partitionBy('subdir')."""
    return atoms.where(F.length("pdb_id") == 4).withColumn("subdir", F.lower(F.substring("pdb_id", 2, 2)))


def finished_jobs(spark: SparkSession, path: str, marker: str = "Job completed.") -> DataFrame:
    """Log files and whether they hold the completion marker: path, done, markers."""
    return _text(spark, path).groupBy("path").agg(F.max(F.contains("value", F.lit(marker))).alias("done"), F.sum(F.contains("value", F.lit(marker)).cast("int")).alias("markers"))
