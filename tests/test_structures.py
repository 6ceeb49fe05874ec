import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.constants import AA_CODES
from corvane.operators import aggregates as A
from corvane.operators import density as D
from corvane.operators import environments as E
from corvane.operators import joins as J
from corvane.sources import library as L
from corvane.sources import structures as S

# A chain of five residues with a break before the last, a ligand of four atoms, water.
RES = [(1, "GLY", (0, 0, 0)), (2, "ALA", (3.8, 0, 0)), (3, "GLU", (7.6, 0, 0)), (4, "SER", (11.4, 0, 0)), (9, "VAL", (25, 0, 0))]


def atom_rows(pdb="1abc", shift=0.0):
    rows, n = [], 0

    def add(record, name, res, chain, no, el, x, y, z, b=20.0):
        nonlocal n
        n += 1
        rows.append((pdb, n, record, name, res, chain, "", no, 0, el, 1.0, b, x + shift, float(y), float(z), "other", None))

    for i, (no, res, (x, y, z)) in enumerate(RES):
        for name, dx, dy in (("N", -1.2, 0.3), ("CA", 0, 0), ("C", 1.2, 0.3), ("O", 1.5, 1.3)):
            add("ATOM", name, res, "A", no, name[0], x + dx, y + dy, z)
        if res != "GLY":
            add("ATOM", "CB", res, "A", no, "C", x, y - 1.5, z + 0.3)
        add("ATOM", "H", res, "A", no, "H", x - 1.2, y + 1.2, z)
    for name, el, x, y, z in (("C1", "C", 5.5, -5.0, 0), ("O1", "O", 4.6, -4.2, 0.5), ("O2", "O", 6.6, -4.2, -0.4), ("C2", "C", 5.5, -6.5, 0.2)):
        add("HETATM", name, "LIG", "L", -1, el, x, y, z)
    add("HETATM", "O", "HOH", "W", 300, "O", 5.5, -2.0, 3.0)
    add("HETATM", "ZN", "ZN", "Z", 301, "ZN", 40, 40, 40)
    return rows


@pytest.fixture(scope="module")
def atoms(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pdb") / "out")
    S.write_pdb(spark.createDataFrame(atom_rows() + atom_rows("2abd", 100.0), schemas.ATOMS), path)
    text = {}
    for r in spark.read.option("basePath", path).text(path).withColumn("f", F.col("pdb_id")).collect():
        text.setdefault(r["f"], []).append(r["value"])
    folder = tmp_path_factory.mktemp("in")
    (folder / "1abc.pdb").write_text("MODEL        1\n" + "\n".join(text["1abc"]) + "\nENDMDL\n" + text["1abc"][0] + "\n" + f"CONECT{32:>5}{33:>5}{34:>5}\n")
    (folder / "2abd.pdb.gz").write_bytes(gzip.compress("\n".join(text["2abd"]).encode()))
    S.read_bonds(spark, str(folder / "1abc.pdb"))
    assert {(r["serial1"], r["serial2"]) for r in S.read_bonds(spark, str(folder / "1abc.pdb")).collect()} == {(32, 33), (32, 34)}
    a = S.read_pdb(spark, str(folder)).cache()
    return a




def LIG():
    return F.col("resname") == "LIG"


MATCH = "biounit string, seg string, chain string, resnum string, resname string, match_no int, atom_names array<string>"


def test_pdb_round_trip(atoms):
    got = {(r["pdb_id"], r["serial"]): r for r in atoms.collect()}
    for r in atom_rows() + atom_rows("2abd", 100.0):
        g = got.pop((r[0], r[1]))
        assert (g["record"], g["name"], g["resname"], g["chain"], g["seg"], g["resnum"], g["element"]) == (r[2], r[3], r[4], r[5], "", r[7], r[9])
        assert np.allclose([g["x"], g["y"], g["z"], g["bfactor"]], [r[12], r[13], r[14], r[11]], atol=1e-3)
    assert not got and atoms.agg(F.countDistinct("pdb_id", "resindex")).first()[0] == 16


def test_cif_equals_pdb(spark, tmp_path):
    cols = ["group_PDB", "id", "type_symbol", "label_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    text = "data_x\n_a.b 'it''s'\n;long\ntext\n;\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in cols) + "ATOM 1 C \"C1'\" ALA A -3 1.5 2 3 1 20.5 1\nHETATM 2 O O . L ? 1 1 1 1 . 1\nATOM 3 C CA ALA A 1 1 1 1 1 1 2\n#\nloop_\n_x.y\n1\n"
    (tmp_path / "7xyz.cif").write_text(text)
    r = S.read_cif(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(x["pdb_id"], x["name"], x["resnum"], x["x"], x["bfactor"], x["resindex"]) for x in r] == [("7xyz", "C1'", -3, 1.5, 20.5, 0), ("7xyz", "O", None, 1.0, None, 1)]


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = [(i, i % 3, *map(float, rng.normal(size=3) * 4)) for i in range(400)] + [(900, 0, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(p, "id int, g int, x double, y double, z double")
    for strict in (False, True):
        got = {(r["id_l"], r["id_r"]) for r in J.radius_join(df, df, 1.7, ("g",), strict=strict).collect()}
        d = lambda a, b: sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) ** 0.5
        assert got == {(a[0], b[0]) for a in p for b in p if a[1] is not None and a[1] == b[1] and d(a, b) <= 1.7}


def test_networks_shell_chains(atoms):
    n = {r["pdb_file"]: {x["resname"] for x in r["residues"]} for r in J.contact_networks(atoms, LIG()).collect()}
    assert n == {k: {"LIG", "ALA", "GLU", "HOH"} for k in ("1abc", "2abd")}
    assert J.contact_networks(atoms.withColumn("bfactor", F.lit(40.01)), LIG()).count() == 0
    shell = {r["resname"] for r in J.ligand_shell(atoms, LIG(), 6.0).select("resname").distinct().collect()}
    assert "ZN" not in shell and "VAL" not in shell and {"LIG", "ALA", "GLU"} <= shell
    assert {r["chain"] for r in J.interacting_chains(atoms, J.contact_networks(atoms, LIG())).select("chain").distinct().collect()} == {"A", "L", "W"}


def test_flanks_stop_at_breaks(atoms):
    b = E.first_atoms(atoms, ("CA",)).where("pdb_id = '1abc'").select("pdb_id", "seg", "chain", "resnum", "resindex", "resname", F.array("x", "y", "z").alias("ca"))
    f = {r["resnum"]: r["flank_seq"] for r in E.flanks(b).collect()}
    assert f[1] == ["X", "X", "vdm", "ALA", "GLU"] and f[3] == ["GLY", "ALA", "vdm", "SER", "X"] and f[9] == ["X", "X", "vdm", "X", "X"]


def env(spark, tmp_path):
    d = tmp_path / "ab"
    d.mkdir(parents=True)
    line = "[('1abc', '', 'L', -1, 1), ('1abc', '', 'A', 2), ('1abc', '', 'A', 3), ('1abc', '', 'A', 1)]"
    (d / "1abc_environments.txt").write_text(line + "\n\n" + "[('2abd', '', 'L', -1, 1), ('2abd', '', 'A', 9)]\n")
    (d / "1abc_fingerprints.npy").write_bytes(b"x")
    (d / "zz_environments.txt").write_text(line)
    return S.read_environments(spark, str(tmp_path))


def test_environment_records_and_library(spark, atoms, tmp_path):
    e = env(spark, tmp_path / "e")
    rows = e.orderBy("line_no").collect()
    assert len(rows) == 2 and rows[0]["cg"]["match_no"] == 1 and [r["resnum"] for r in rows[0]["residues"]] == [2, 3, 1] and rows[1]["line_no"] == 2
    m = spark.createDataFrame([(p, "", "L", "-1", "LIG", 1, ["C1", "O1", "O2"]) for p in ("1abc", "2abd")], MATCH)
    rec = E.contact_records(atoms, m, e, "acid")
    got = {(r["source_id"], r["seq"]["combo_no"]): r for r in rec.collect()}
    assert rec.schema.simpleString().replace("double", "float") == spark.createDataFrame([], schemas.VDG_RECORDS).schema.simpleString().replace("double", "float")
    assert [got["1abc", i]["aa_bucket"] for i in range(6)] == ["ALA", "GLU", "bb", "ALA_GLU", "ALA_bb", "GLU_bb"] and got["2abd", 0]["aa_bucket"] == "bb"  # its nitrogen is nearer than its side chain
    for r in got.values():
        assert np.allclose(r["cg_coords"][0], 0, atol=1e-6) and np.allclose([c[2] for c in r["cg_coords"]], 0, atol=1e-6)
    from corvane.operators.clustering import nonredundant_library

    lib = nonredundant_library(rec, {"acid": [0, 1, 1]})
    L.write_library(lib, str(tmp_path / "lib"))
    back = L.read_library(spark, str(tmp_path / "lib"), "acid", 2, "ALA_GLU")
    assert back.count() == 1 and L.read_library(spark, str(tmp_path / "lib"), "acid", 1, "TRP").count() == 0
    assert A.bucket_counts(L.read_library(spark, str(tmp_path / "lib"))).count() == 3
    at = E.library_atoms(back)
    assert {r["name"] for r in at.where("role = 'vdm'").collect()} == {"N", "CA", "C", "O", "CB"} and at.where("role = 'cg'").count() == 3
    with pytest.raises(Exception):
        L.write_library(lib, str(tmp_path / "lib"))
    cg = at.where("role = 'cg'").select("cluster_id", "chain", "resnum", "name", "x", "y", "z")
    par = atoms.where(LIG() & (F.col("pdb_id") == "1abc")).select(F.lit(1).alias("cluster_id"), "chain", "resnum", "name", "x", "y", "z")
    (c2,) = E.append_ligand(cg, par, ["cluster_id"]).collect()
    assert c2["name"] == "C2" and abs((c2["x"] ** 2 + c2["y"] ** 2 + c2["z"] ** 2) ** 0.5 - (1.5**2 + 0.2**2) ** 0.5) < 0.02
    L.write_records(rec, str(tmp_path / "r"))
    assert L.read_records(spark, str(tmp_path / "r")).count() == rec.count()


def test_ambiguous_and_incomplete_groups(spark, atoms):
    more = atoms.where("pdb_id = '1abc' and name = 'O2'").withColumn("serial", F.lit(500)).withColumn("x", F.col("x") + 5)
    both = atoms.unionByName(more)
    m = spark.createDataFrame([("1abc", "", "L", "-1", "LIG", 1, ["C1", "O1", "O2"]), ("1abc", "", "L", "-1", "LIG", 2, ["C1", "NX"])], MATCH).withColumnRenamed("biounit", "pdb_id")
    (r,) = E.group_points(both, m).collect()
    assert r["match_no"] == 1 and abs(r["cg_coords"][2][0] - 6.6) < 1e-6
    assert E.first_atoms(both, ("O2",)).where("ambiguous").count() == 1


def test_binding_site_combos(atoms):
    c = E.binding_site_combos(atoms.where("pdb_id = '1abc'"), LIG()).collect()
    assert {(r["subset_size"], r["aa_bucket"]) for r in c} == {(1, "ALA"), (1, "bb"), (1, "GLU"), (2, "ALA_GLU"), (2, "ALA_bb"), (2, "GLU_bb"), (2, "bb_bb")}
    assert all(len(r["q_bb"]) == r["subset_size"] for r in c)


def test_graph_tables(atoms):
    n = E.graph_nodes(atoms.where("pdb_id = '1abc'"))
    first = n.where("node_id = 0").first()
    assert (first["atomic_num"], first["num_hs"], first["is_protein"]) == (7.0, 1.0, 1.0) and n.where("is_protein = 0").count() == 4
    e = {(r["src"], r["dst"]) for r in E.graph_edges(n).collect()}
    assert (0, 1) in e and (1, 0) in e and all((b, a) in e for a, b in e)


def test_kde_and_dx(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(30, 3)) * [1, 2, 3]
    g = D.kde_grid(spark.createDataFrame([tuple(map(float, r)) for r in p], "x double, y double, z double"), steps=5)
    cov = np.cov(p.T) * 0.04
    for r in g.where("ix = 2").collect():
        d = p - [r["x"], r["y"], r["z"]]
        want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)).sum() / (30 * np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov)))
        assert np.isclose(r["density"], want, rtol=1e-9)
    L.write_lines(D.dx_lines(g, 5), str(tmp_path / "dx"), "place")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "dx")).collect()]
    assert lines[0].endswith("counts 5 5 5") and len(lines) == 7 + 42 + 1 and lines[-1].startswith("object 'density'")
    flat = [float(x) for line in lines[7:-1] for x in line.split()]
    order = sorted(g.collect(), key=lambda r: (r["iz"], r["iy"], r["ix"]))
    assert np.allclose(flat, [r["density"] for r in order], rtol=1e-5)


def test_text_sources(spark, tmp_path):
    (tmp_path / "l.smi").write_text('CCO\tA1\tname\nCC\t"B2"\n\n')
    assert [tuple(r) for r in S.read_ligands(spark, str(tmp_path / "l.smi")).orderBy("lig_id").collect()] == [("CCO", "A1", "name"), ("CC", "B2", None)]
    (tmp_path / "bad.smi").write_text("CCO\n")
    with pytest.raises(Exception):
        S.read_ligands(spark, str(tmp_path / "bad.smi")).collect()
    rec = "mol{i}\n  x\n\n  2  1  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.2000    0.0000    0.0000 O   0  0\n  1  2  2  0\nM  END\n$$$$\n"
    (tmp_path / "m.sdf").write_text(rec.format(i=1) + rec.format(i=2))
    got = S.read_sdf(spark, str(tmp_path / "m.sdf")).orderBy("name").collect()
    assert [r["name"] for r in got] == ["mol1", "mol2"] and got[0]["symbols"] == ["C", "O"] and got[1]["bonds"][0]["bond_order"] == 2
    for d, n in (("ab", "1abc.pdb"), ("xx", "2abd.pdb.gz")):
        (tmp_path / "db" / d).mkdir(parents=True)
        (tmp_path / "db" / d / n).write_bytes(b"x")
    assert [r["id"] for r in S.layout_problems(spark, str(tmp_path / "db")).collect()] == ["2abd"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("x\nJob completed.\n")
    (tmp_path / "logs" / "b.log").write_text("x\n")
    assert sorted(r["done"] for r in S.finished_jobs(spark, str(tmp_path / "logs")).collect()) == [False, True]


def test_configuration():
    job = L.RerankJob.from_dict({"library_dir": "l", "query_pdbs_dir": "q", "outdir": "o", "lig_smiles": "CC", "frags_to_exclude": None})
    assert job.rmsd_threshold == 0.7 and job.frags_to_exclude == []
    with pytest.raises(ValueError):
        L.RerankJob.from_dict({"outdirr": "x"})
    assert L.job_script("run $frag $n", {"frag": "a", "n": 2}) == "run a 2"
    with pytest.raises(KeyError):
        L.job_script("run $frag", {})


def test_group_contact_table(spark):
    c = spark.createDataFrame([("p", "L", 1, "C1", a, "A", t) for a, t in (("ALA", "wc"), ("ALA", "cc"), ("HOH", "wc"), ("GLU", "cc"))] + [("q", "L", 1, "C1", "ALA", "A", "wc"), ("r", "L", 1, "C1", "HOH", "A", "zz"), ("r", "L", 1, "C1", "ALA", "A", "cc")], schemas.CONTACTS)
    m = spark.createDataFrame([(p, "L", "1", 1, ["C1", "C2"]) for p in "pqr"], "probe_name string, chain string, resnum string, match_no int, atom_names array<string>")
    pr = spark.createDataFrame([("wc", 1), ("cc", 3), ("zz", 9)], "atomtype2 string, precedence int")
    assert {(r["probe_name"], r["resname2"], r["score"]) for r in E.group_contact_table(c, m, pr, AA_CODES).collect()} == {("p", "ALA", -4.0), ("p", "GLU", -3.0), ("q", "ALA", -1.0), ("r", "ALA", -3.0)}
    assert {r["probe_name"] for r in E.group_contact_table(c, m, pr, AA_CODES, ["wc"]).collect()} == {"p"}


def test_sd_records_of_both_versions_and_bad_ones(spark, tmp_path):
    v2 = "two\n\n\n  2  1  0  0  0  0            999 V2000\n    0.0 0.0 0.0 C\n    1.2 0.0 0.0 O\n  1  2  2\nM  END\n$$$$\n"
    v3 = "three\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS 2 1 0 0 0\nM  V30 BEGIN ATOM\nM  V30 1 C 0 0 0 0\nM  V30 2 N 1.1 0 0 0\nM  V30 END ATOM\nM  V30 BEGIN BOND\nM  V30 1 3 1 2\nM  V30 END BOND\nM  V30 END CTAB\n$$$$\n"
    (tmp_path / "m.sdf").write_text(v2 + v3 + v2.replace("  2  1  0", " xx  1  0").replace("two", "bad") + v2.replace("  2  1  0", " 99  1  0"))
    got = S.read_sdf(spark, str(tmp_path / "m.sdf")).collect()
    assert {r["name"]: (r["symbols"], [tuple(b) for b in r["bonds"]]) for r in got if r["name"]} == {"two": (["C", "O"], [(0, 1, 2)]), "three": (["C", "N"], [(0, 1, 3)])}
    assert len(got) == 4 and sum(r["error"] is not None for r in got) == 2


def test_networks_of_a_stopped_run(spark, tmp_path):
    from corvane import schemas

    key = lambda n: {"seg": "", "chain": "A", "resnum": n, "resname": "LIG"}
    nets = lambda *names: spark.createDataFrame([{"pdb_file": n, "lig": key(1), "residues": [key(2)]} for n in names], schemas.NETWORKS)
    path = str(tmp_path / "nets")
    L.append_networks(nets("1abc"), path)
    todo = spark.createDataFrame([("1abc",), ("2abc",)], "pdb_file string")
    assert [r[0] for r in L.unfinished(todo, L.read_networks(spark, path)).collect()] == ["2abc"]
    L.append_networks(nets("1abc", "2abc"), path)
    assert sorted(r["pdb_file"] for r in L.read_networks(spark, path).collect()) == ["1abc", "2abc"]
    assert L.PoseValidationJob.from_dict({"library_dir": "l", "query_pdbs_dir": "q", "outdir": "o", "query_pdbs": None}).rmsd_threshold == 0.7
