"""Core queries against DuckDB at the smallest scale, entry contract and streaming."""

import math
import os

import pytest

from corvane.plans import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, DIR).toPandas()
    if name in q.ORACLES:
        want = duck.execute(q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_over_many_stretches(spark, monkeypatch):
    import random

    from corvane.operators import sets as S

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140)] + [(4000, 4000)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(8)
    monkeypatch.setattr(S, "STRETCH", 40)  # many tasks and rounds
    got = {r["node"]: r["component"] for r in S.connected_components(df, spark.createDataFrame([(5000,), (7,)], "node long")).collect()}
    assert got == {x: find(x) for x in up} | {5000: 5000}
    assert S.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_hand(points, target):
    """RMSD after the best superposition."""
    import numpy as np

    x, y = np.asarray(points, float), np.asarray(target, float)
    x, y = x - x.mean(0), y - y.mean(0)
    u, s, v = np.linalg.svd(x.T @ y)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
    return float(np.sqrt(((x @ turn - y) ** 2).sum(1).mean()))


def test_pose_matching_equals_all_pairs(spark):
    from itertools import permutations

    from corvane.operators import matching as M

    def fits_by_hand(queries, library):
        want, every = {}, {}
        for a in queries:
            for b in library:
                if (a["aa_bucket"], a["subset_size"]) != (b["aa_bucket"], b["subset_size"]):
                    continue
                names = [r["resname"] for r in b["scrr"]]
                orders = [o for o in permutations(range(len(names))) if [names[i] for i in o] == list(a["labels"])]
                flat = [p for r in a["q_bb"] for p in r]
                fits = [(round(by_hand([p for i in o for p in b["bb_coords"][i]] + list(b["cg_coords"]), flat + list(c)), 5), n, k) for n, o in enumerate(orders) for k, c in enumerate(a["q_cg"])]
                key = a["pdbfile"], b["vdg_index"]
                best = min(fits)
                if best[0] <= 2.0:
                    want[key] = best[0]
                for d, n, k in fits:
                    if round(d, 2) < 2.0:
                        every[(*key, n, k)] = d
        return want, every

    def best(df):
        return {(r["pdbfile"], r["vdg_index"]): r["vdg_rmsd"] for r in df.collect()}

    def hits(df):
        return {(r["pdbfile"], r["vdg_index"], r["aa_perm_idx"], r["q_cg_perm_idx"]): r["vdg_rmsd"] for r in df.collect()}

    def same(got, want):
        return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)

    tables = q.match_tables(spark, DIR)
    queries, library = (x.collect() for x in tables)
    want, every = fits_by_hand(queries, library)
    assert len(want) >= len(queries) and same(best(M.pose_match(*tables, 2.0)), want)
    pairs = {(r["pdbfile"], r["vdg_index"]) for r in q.QUERIES["pair_match"](spark, DIR).collect()}
    assert pairs == {k for k in want if int(k[0]) % 2}
    assert same(hits(M.validate_known_poses(*tables, 2.0)), every)

    asked = q.match_tables(spark, DIR, search=True)[0].collect()
    assert {int(a["pdbfile"]) for a in asked} == {b["vdg_index"] for b in library if b["vdg_index"] % 20 == 0} and {a["subset_size"] for a in asked} == {1, 2}
    want, every = fits_by_hand(asked, library)
    assert {b % 2 for _, b in want} == {0, 1} and same(best(q.QUERIES["pose_match"](spark, DIR)), want)
    assert same(hits(q.QUERIES["known_pose_validation"](spark, DIR)), every)


def test_superposed_rmsd_equals_one_pair_at_a_time(spark):
    rows = {r["vec_id"]: r for r in q.coords(spark, DIR).collect()}
    least = {}
    for r in rows.values():
        least[r["label"]] = min(r["vec_id"], least.get(r["label"], r["vec_id"]))
    got = q.QUERIES["kabsch_rmsd"](spark, DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["known"] == least[rows[r["pose"]]["label"]] and abs(r["rmsd"] - by_hand(rows[r["pose"]]["c"], rows[r["known"]]["c"])) < 1e-5


def test_fragments_and_symmetry_equal_one_molecule_at_a_time(spark):
    from collections import defaultdict

    from corvane.functions import chem

    rows = q.ligands(spark, DIR).collect()
    assert len({r["smiles"] for r in rows}) > 150
    found = defaultdict(set)
    for r in rows:
        for f in chem.fragments(chem.parse_smiles(r["smiles"]), 2, 4, 5):
            found[f.elements, f.smiles, f.key].add(r["lig_id"])
    got = {(r["elements_str"], r["smiles"], r["canonical"]): (r["ligands"], r["symmetry"]) for r in q.QUERIES["smiles_fragments"](spark, DIR).collect()}
    assert got == {k: (len(v), chem.symmetry_string(k[1])) for k, v in found.items() if len(v) >= 10}
    keys = {r["lig_id"]: (r["symmetry"], r["canonical"]) for r in q.QUERIES["wl_symmetry"](spark, DIR).collect()}
    assert keys == {r["lig_id"]: (chem.symmetry_string(r["smiles"]), chem.canonical_key(chem.parse_smiles(r["smiles"]))) for r in rows}


def test_batches_in_order(spark):
    from corvane.operators import windows as O

    df = spark.createDataFrame([(g, i) for g, n in ((1, 10), (None, 4), (2, 2)) for i in range(n)], "g int, i int")
    got = {(r["g"], r["i"]): r["batch"] for r in O.batches(df, 3, ["i"], ["g"]).collect()}
    assert [got[1, i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3] and [got[None, i] for i in range(4)] == [1, 1, 2, 3] and [got[2, 0], got[2, 1]] == [1, 2]
    alone = {r["i"]: r["batch"] for r in O.batches(spark.range(7).withColumnRenamed("id", "i"), 2, ["i"]).collect()}
    assert [alone[i] for i in range(7)] == [1, 1, 1, 1, 2, 2, 2]
    assert [r["batch"] for r in O.strided(spark.range(5), 2, ["id"]).orderBy("id").collect()] == [1, 2, 1, 2, 1]
    assert O.batches(spark.range(0), 2, ["id"]).count() == 0


def test_radius_join_is_an_equi_join(spark):
    plan = q.QUERIES["radius_join"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_streaming_counts_equal_batch(spark, tmp_path):
    from corvane.operators.aggregates import bucket_counts
    from corvane.streaming import incremental as I

    src = q.pairs(spark, DIR).select("aa_bucket")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    s = I.running_bucket_counts(I.library_stream(spark, str(tmp_path / "in"), "aa_bucket string", 1))
    run = s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, bucket_counts(src).collect()))
