import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays as R
from corvane.functions import text as C
from corvane.operators import selection as S

from corvane.operators import selection as X


def test_predicates(spark):
    rows = [("p", 1, "ATOM", "CA", "ALA", "A", "", 1, "C", 0.0, 0.0, 0.0), ("p", 2, "ATOM", "CB", "ALA", "A", "", 1, "C", 1.0, 0.0, 0.0), ("p", 3, "HETATM", "O", "HOH", "W", "", 2, "O", 3.0, 0.0, 0.0), ("p", 4, "HETATM", "ZN", "ZN", "Z", None, 3, "ZN", 9.0, 0.0, 0.0), ("p", 5, "ATOM", "H", "ALA", "A", "", 1, "H", 9.5, 0.0, 0.0)]
    a = spark.createDataFrame(rows, "pdb_id string, serial int, record string, name string, resname string, chain string, seg string, resnum int, element string, x double, y double, z double")
    pick = lambda c: [r["serial"] for r in a.where(c).orderBy("serial").collect()]
    assert pick(S.is_backbone()) == [1] and pick(S.is_sidechain()) == [2, 5] and pick(S.is_water()) == [3] and pick(S.is_ion()) == [4]
    assert pick(S.is_hetero()) == [3, 4] and pick(S.is_heavy()) == [1, 2, 3, 4] and pick(S.in_residue(None, "Z", 3)) == [4] and pick(S.is_protein()) == [1, 2, 5]
    assert sorted(r["serial"] for r in S.around(a, S.is_ion(), 1.0).collect()) == [4, 5]
    assert sorted(r["serial"] for r in S.around(a, S.is_ion(), 1.0, whole=True).collect()) == [1, 2, 4, 5]


def test_named_permutations():
    assert R.named_permutations(["C", "O1", "O2"], [["O1", "O2"]]) == [[0, 1, 2], [0, 2, 1]]
    for bad in ([["O1", "OX"]], [["O1", "O2"], ["O2", "C"]]):
        with pytest.raises(ValueError):
            R.named_permutations(["C", "O1", "O2"], bad)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(C.strip_structure_suffix(F.lit("/a/b/1abc.pdb.gz"))) == "1abc" and one(C.unbracket(F.lit("[C][N+]"))) == "C[N+]"
    assert one(C.match_file_rmsd(F.lit("a_b_0.53.pdb"))) == 0.53 and one(C.match_file_size(F.lit("a_b_c_d_e_f"))) == 1
    assert one(C.pseudo_ligand(F.lit("ALAX"), ("ALA",))) and not one(C.pseudo_ligand(F.lit("LIG"), ("ALA",)))
    assert one(C.percent_identity(F.array(F.lit("A"), F.lit("X")), F.array(F.lit("X"), F.lit("A")))) == 0.0
    assert one(C.undesired_elements(F.lit("CB(O)O"))) and not one(C.undesired_elements(F.lit("CCBr")))
    assert one(C.equal_places(F.lit("6br5"), F.lit("6bny"))) == 2 and not one(C.similar_ids(F.lit("6br5"), F.lit("6bn")))
    with pytest.raises(Exception):
        one(C.match_file_size(F.lit("a_b")))


def test_comparisons_and_points_by_name(spark):
    import pytest

    rows = [("p", None, "A", 1, "ALA", n, i, 0.5 * i, float(i), 0.0, 0.0) for i, n in enumerate(("N", "CA", "C", "CB"))] + [("p", None, "A", 2, "GLY", "CA", 9, None, 9.0, 0.0, 0.0)]
    a = spark.createDataFrame(rows, "pdb_id string, seg string, chain string, resnum int, resname string, name string, serial int, occupancy double, x double, y double, z double")
    assert a.where(X.compare("occupancy", ">", 0.6) & ~X.one_of("name", "CB")).count() == 1 and a.where(X.compare("resnum", "!=", 1)).count() == 1
    with pytest.raises(ValueError):
        X.compare("resnum", "~", 1)
    one = a.where("resnum = 1")
    assert [list(map(list, r["points"])) for r in X.named_points(one, ["CA", "N"]).collect()] == [[[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]]
    for bad in (a, one.union(one.where("name = 'CA'"))):
        with pytest.raises(Exception, match="once"):
            X.named_points(bad, ["CA", "N"]).collect()
    assert X.single_residues(a, ["pdb_id"]).count() == 0 and X.single_residues(one, ["pdb_id"]).count() == 4
