from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import chem
from corvane.operators import ligands as L
from corvane.operators import environments as E
from corvane.operators import matching as M

# acetate: carbon, carboxyl carbon, two oxygens
XYZ = {"C2": (0.0, 0.0, 0.0), "C1": (1.5, 0.0, 0.0), "O1": (2.1, 1.1, 0.0), "O2": (2.1, -1.1, 0.0)}


def rows(pdb, shift=0.0):
    out, n = [], 0
    for name, (x, y, z) in XYZ.items():
        n += 1
        out.append((pdb, n, "HETATM", name, "ACT", "L", "", 1, 1, name[0], 1.0, 20.0, x + shift, y, z, "other", None))
    for name, x, y, z in (("N", 4.0, 2.0, 0.0), ("CA", 5.0, 1.2, 0.3), ("C", 6.0, 2.0, 0.5), ("O", 6.2, 3.1, 0.4), ("CB", 5.2, 0.2, 1.4)):
        n += 1
        out.append((pdb, n, "ATOM", name, "SER", "A", "", 7, 0, name[0], 1.0, 20.0, x + shift, y, z, "other", None))
    return out


def test_poses_from_structures_match_the_library(spark):
    atoms = spark.createDataFrame(rows("pose") + rows("xtal", 30.0), schemas.ATOMS)
    templates = spark.createDataFrame([("ACT", "CC(=O)[O-]"), ("ACT", "CCCC"), ("BAD", "C1CC1")], "resname string, smiles string")
    p = L.fragment_placings(atoms, templates)
    got = p.where("pdb_id = 'pose'").collect()
    acid = chem.canonical_key(chem.parse_smiles("CC(=O)[O-]"))
    assert {r["canonical"] for r in got} == {acid} and {r["site"] for r in got} == {0} and {tuple(sorted(r["names"])) for r in got} == {("C1", "C2", "O1", "O2")}
    combos = E.binding_site_combos(atoms, F.col("resname") == "ACT")
    q = L.pose_queries(p, combos, spark.createDataFrame([("acid", acid)], "name string, canonical string"))
    assert {r["aa_bucket"] for r in q.collect()} == {"SER", "bb"}
    r = got[0]
    bb = [[4.0, 2.0, 0.0], [5.0, 1.2, 0.3], [6.0, 2.0, 0.5]]
    lib = spark.createDataFrame([{"frag": "acid", "subset_size": 1, "aa_bucket": "SER", "cluster_id": 1, "cluster_size": 1, "first_stage_cluster_id": 1, "second_stage_cluster_id": 1, "parent": "p", "cg_coords": r["coords"], "bb_coords": [bb], "vdm_heavy": None, "scrr": [{"seg": "", "chain": "A", "resnum": 7, "resname": "SER"}], "cg_names": None, "cg_elements": None, "cg_seg": None, "cg_chain": None, "cg_resnum": None, "cg_resname": None}], schemas.NR_VDGS)
    hits = M.pose_match(q, lib.withColumn("vdg_index", F.lit(0)), 0.3).collect()
    assert {h["pdbfile"] for h in hits} == {"pose", "xtal"} and max(h["vdg_rmsd"] for h in hits) < 1e-4


def test_template_that_does_not_fit(spark):
    atoms = spark.createDataFrame(rows("pose"), schemas.ATOMS)
    assert L.fragment_placings(atoms, spark.createDataFrame([("ACT", "NCCN")], "resname string, smiles string")).count() == 0


def test_ligand_rmsd_over_symmetric_atoms(spark):
    ref = np.array(list(XYZ.values()))
    rows_ = [("a", "CC(=O)[O-]", None, ref[[0, 1, 3, 2]].tolist()), ("b", "CC(=O)[O-]", None, (ref + [3, 0, 0]).tolist())]
    t = "pdb_id string, smiles string, names array<string>, coords array<array<double>>"
    got = {r["pdb_id"]: r["rmsd"] for r in L.ligand_rmsd(spark.createDataFrame(rows_, t), spark.createDataFrame([("x", "CC(=O)[O-]", None, ref.tolist())], t)).collect()}
    assert got["a"] < 1e-9 and abs(got["b"] - 3) < 1e-9


def test_least_matching_equals_all_orders():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(20):
            cost = rng.random((n, n)) if n % 2 else rng.integers(0, 4, (n, n)).astype(float)
            assert abs(L.least_matching(cost) - min(sum(cost[i, j] for i, j in enumerate(o)) for o in permutations(range(n)))) < 1e-9


def test_ligand_rmsd_with_many_orders(spark):
    smiles = "FC(F)(F)C(F)(F)C(F)(F)F"
    classes = np.array(chem.symmetry_classes(chem.parse_smiles(smiles)))
    rng = np.random.default_rng(5)
    ref, order = rng.normal(size=(len(classes), 3)) * 9, np.arange(len(classes))
    for k in np.unique(classes):
        order[classes == k] = np.roll(order[classes == k], 1)
    t = "pdb_id string, smiles string, names array<string>, coords array<array<double>>"
    r = L.ligand_rmsd(spark.createDataFrame([("a", smiles, None, (ref[order] + [0.3, 0, 0]).tolist())], t), spark.createDataFrame([("x", smiles, None, ref.tolist())], t)).first()
    assert sorted(np.unique(classes, return_counts=True)[1]) == [1, 2, 2, 6] and abs(r["rmsd"] - 0.3) < 1e-9


def test_structures_of_ligands(spark):
    have, none = L.structures_of_ligands(spark.createDataFrame([("A",), ("B",)], "lig_id string"), spark.createDataFrame([("A", "1abc")], "lig_id string, pdb_id string"))
    assert have.count() == 1 and none.first()["lig_id"] == "B"


def test_ligand_edges_have_the_template_orders(spark):
    from corvane.operators.environments import ligand_edges

    rows = [("g", 3, 6.0, 0.0, 0.0), ("g", 4, 6.0, 0.0, 1.5), ("g", 5, 8.0, 0.0, 2.7), ("h", 0, 6.0, 1.0, 0.0), ("h", 1, 7.0, 0.0, 1.3)]
    nodes = spark.createDataFrame([(g, n, z, p, x, 0.0, 0.0) for g, n, z, p, x in rows], "graph_id string, node_id int, atomic_num float, is_protein float, x float, y float, z float")
    got = {(r["graph_id"], r["src"], r["dst"]): r["bond_type"] for r in ligand_edges(nodes, spark.createDataFrame([("g", "CC=O")], "graph_id string, smiles string")).collect()}
    assert got == {("g", 3, 4): 1.0, ("g", 4, 3): 1.0, ("g", 4, 5): 2.0, ("g", 5, 4): 2.0}
