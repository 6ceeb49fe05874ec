"""From atoms and environments to contact records, and back to atoms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AROMATIC_ATOMS, AROMATIC_RESIDUES, BACKBONE_ATOMS, BACKBONE_LABEL, CENTRE, FRAME_ATOMS, GAP
from ..functions.geometry import distance2, in_frame, local_frame, superpose
from . import joins as J
from .windows import chain_walk

RES = ["pdb_id", "seg", "chain", "resnum"]


def contact_label(aa: Column, side: Column, backbone: Column) -> Column:
    """How a residue is touched: by its backbone, or as its amino acid.

    No side-chain distance means backbone; a side chain within 4.4 means the amino acid; else
    backbone only if it is nearer by more than 0.3.
    """
    return F.when(side.isNull(), BACKBONE_LABEL).when(side <= 4.4, aa).when((backbone < side) & (side - backbone > 0.3), BACKBONE_LABEL).otherwise(aa)


def heavy_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.coalesce(F.col("element"), F.substring("name", 1, 1)).isin("H", "D"))


def protein(atoms: DataFrame) -> DataFrame:
    """Atoms of residues that have an alpha carbon of a polymer record."""
    return J.whole_residues(atoms, atoms.where("record = 'ATOM' and name = 'CA'"))


def first_atoms(atoms: DataFrame, names: tuple[str, ...], most_apart: float = 0.2) -> DataFrame:
    """The first atom of each name and residue, with `spread`, the distance of the farthest double."""
    key = [*RES, "name"]
    w = Window.partitionBy(*key).orderBy("serial")
    a = atoms.where(F.col("name").isin(*names)).select("*", F.row_number().over(w).alias("__n"), *(F.first(c).over(w).alias(f"__{c}") for c in "xyz"))
    d = F.sqrt(distance2(*((F.col(c), F.col(f"__{c}")) for c in "xyz")))
    a = a.withColumn("spread", F.max(d).over(Window.partitionBy(*key))).where("__n = 1")
    return a.withColumn("ambiguous", F.col("spread") > most_apart).drop("__n", "__x", "__y", "__z")


def backbones(atoms: DataFrame) -> DataFrame:
    """bb (N, CA, C points) and resname of each residue that has all three and one name."""
    a = first_atoms(atoms, FRAME_ATOMS)
    place = F.array_position(F.array(*(F.lit(n) for n in FRAME_ATOMS)), F.col("name"))
    g = a.groupBy(*RES).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.array("x", "y", "z").alias("c")))).alias("v"), F.countDistinct("resname").alias("names"), F.first("resname").alias("resname"), F.count("*").alias("n"))
    return g.where("n = 3 and names = 1").select(*RES, "resname", F.transform("v", lambda v: v["c"]).alias("bb"))


def group_points(atoms: DataFrame, matches: DataFrame) -> DataFrame:
    """cg points, names and elements of each match in its order; incomplete ones and collapsed or
    straight frames are left out. matches: pdb_id, seg, chain, resnum, match_no, atom_names.

    Of atoms with one name the one nearest to the middle of the unambiguous ones is taken; a
    match whose nearest is more than 8 away is left out.
    """
    m = matches.select("pdb_id", "seg", "chain", F.col("resnum").cast("int").alias("resnum"), "match_no", F.size("atom_names").alias("want"), F.posexplode("atom_names").alias("cg_index", "name"))
    j = m.join(atoms.drop("cg_index", "role"), [*RES, "name"])
    key = [*RES, "match_no"]
    per = Window.partitionBy(*key, "cg_index")
    j = j.withColumn("copies", F.count("*").over(per))
    middle = [F.avg(F.when(F.col("copies") == 1, F.col(c))).over(Window.partitionBy(*key)).alias(f"__{c}") for c in "xyz"]
    j = j.select("*", *middle).withColumn("away", F.when(F.col("copies") > 1, F.sqrt(distance2(*((F.col(c), F.coalesce(F.col(f"__{c}"), F.col(c))) for c in "xyz")))).otherwise(0.0))
    j = j.withColumn("__n", F.row_number().over(per.orderBy("away", "serial"))).where("__n = 1")
    g = j.groupBy(*key, "want").agg(F.array_sort(F.collect_list(F.struct("cg_index", F.array("x", "y", "z").alias("c"), "name", "element", "resname"))).alias("v"), F.max("away").alias("away"))
    out = g.where((F.size("v") == F.col("want")) & (F.col("away") <= 8)).select(
        *key, F.transform("v", lambda v: v["c"]).alias("cg_coords"), F.transform("v", lambda v: v["name"]).alias("cg_names"), F.transform("v", lambda v: v["element"]).alias("cg_elements"), F.transform("v", lambda v: v["resname"]).alias("cg_resname")
    )
    return out.where((F.size("cg_coords") < 3) | (_bend("cg_coords") > 1e-6))


def _bend(points: str) -> Column:
    """Length of the cross product at the first of three points; 0 on a line."""
    p = [[F.get(F.get(points, F.lit(i)), F.lit(k)) for k in range(3)] for i in range(3)]
    u, v = [p[1][k] - p[0][k] for k in range(3)], [p[2][k] - p[0][k] for k in range(3)]
    c = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(sum((x * x for x in c), F.lit(0.0)))


def flanks(residues: DataFrame, k: int = 2, most_step: float = 4.5) -> DataFrame:
    """flank_seq and flank_ca of each residue: -k..k, cut off at the first chain break outward.

    residues: pdb_id, seg, chain, resnum, resindex, resname, ca (point or null). The centre is
    labelled as such, places beyond a break are gaps with NaN points.
    """
    w = Window.partitionBy("pdb_id").orderBy("resindex")
    before = F.lag("ca").over(w)
    step = F.sqrt(distance2(*((F.col("ca")[i], before[i]) for i in range(3))))
    gap = F.col("ca").isNull() | before.isNull() | (step > most_step) | (F.col("resindex") - F.lag("resindex").over(w) != 1)
    g = chain_walk(residues, ["pdb_id"], ["resindex"], gap, k)
    nan = F.array(*(F.lit(float("nan")) for _ in range(3)))
    seq, cas = [], []
    for i in range(-k, k + 1):
        if i == 0:
            seq.append(F.lit(CENTRE))
            cas.append(F.coalesce(F.col("ca"), nan))
            continue
        ok = F.col(f"{'before' if i < 0 else 'after'}_{abs(i)}") & F.col("ca").isNotNull()
        seq.append(F.when(ok, F.lag("resname", -i).over(w)).otherwise(GAP))
        cas.append(F.when(ok, F.lag("ca", -i).over(w)).otherwise(nan))
    return g.select(*RES, F.array(*seq).alias("flank_seq"), F.array(*cas).alias("flank_ca"))


def contact_records(atoms: DataFrame, matches: DataFrame, environments: DataFrame, frag: str, k: int = 2, own_frame: bool = True) -> DataFrame:
    """One record (schemas.VDG_RECORDS) for each environment and each one or two of its residues.

    environments: schemas.ENVIRONMENTS, whose cg names a match. Residues need N, CA, C and a
    heavy atom. own_frame: coordinates in the frame of the group's first three atoms.
    """
    atoms = heavy_atoms(atoms)
    cg = group_points(atoms, matches.withColumnRenamed("biounit", "pdb_id"))
    bb = backbones(atoms)
    cas = first_atoms(atoms, ("CA",)).select(*RES, F.array("x", "y", "z").alias("ca"))
    res = atoms.groupBy(*RES).agg(F.first("resindex").alias("resindex"), F.first("resname").alias("resname")).join(cas, RES, "left")
    fl = flanks(res, k)
    heavy = atoms.groupBy(*RES).agg(F.array_sort(F.collect_list(F.struct("serial", F.array("x", "y", "z").alias("c"), "name", "element"))).alias("h"))
    env = environments.select("subdir", "file", "line_no", F.col("biounit").alias("pdb_id"), F.col("cg.seg").alias("cg_s"), F.col("cg.chain").alias("cg_c"), F.col("cg.resnum").alias("cg_r"), F.col("cg.match_no").alias("match_no"), F.posexplode("residues").alias("at", "r"))
    parts = env.select("*", F.col("r.seg").alias("seg"), F.col("r.chain").alias("chain"), F.col("r.resnum").alias("resnum")).join(bb, RES).join(heavy, RES).join(fl, RES)
    c = cg.select("pdb_id", F.col("seg").alias("cg_s"), F.col("chain").alias("cg_c"), F.col("resnum").alias("cg_r"), "match_no", "cg_coords", "cg_names", "cg_elements", "cg_resname")
    parts = parts.join(c, ["pdb_id", "cg_s", "cg_c", "cg_r", "match_no"])

    def least(side: bool) -> Column:
        own = F.filter("h", lambda a: a["name"].isin(*BACKBONE_ATOMS) if not side else ~a["name"].isin(*BACKBONE_ATOMS, "OXT"))
        return F.array_min(F.flatten(F.transform(own, lambda a: F.transform("cg_coords", lambda p: F.sqrt(distance2(*((a["c"][i], p[i]) for i in range(3))))))))

    label = contact_label(F.col("resname"), F.when(F.col("resname") != "GLY", least(True)), least(False))
    one = F.struct(label.alias("label"), "at", "seg", "chain", "resnum", "resname", "bb", "flank_seq", "flank_ca", "h")
    g = parts.withColumn("v", one).groupBy("subdir", "file", "line_no", "pdb_id", "cg_s", "cg_c", "cg_r", "match_no").agg(F.array_sort(F.collect_list("v")).alias("vs"), *(F.first(x).alias(x) for x in ("cg_coords", "cg_names", "cg_elements", "cg_resname")))
    # residues in the environment's own order make the subsets, labels order each subset
    g = g.withColumn("vs", F.transform(F.array_sort(F.transform("vs", lambda v: F.struct(v["at"].alias("o"), v.alias("v")))), lambda x: x["v"]))
    n = F.size("vs")
    ones = F.transform("vs", lambda v: F.array(v))
    twos = F.flatten(F.transform("vs", lambda a, i: F.transform(F.slice("vs", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.array(a, b))))
    e = g.select("*", F.posexplode(F.concat(ones, twos)).alias("combo_no", "combo"))
    e = e.withColumn("combo", F.transform(F.array_sort(F.transform("combo", lambda v: F.struct(v["label"].alias("l"), v["at"].alias("o"), v.alias("v")))), lambda x: x["v"]))
    t = lambda f: F.transform("combo", f)
    same = lambda c_: F.transform("cg_names", lambda _: c_)
    out = e.select(
        F.lit(frag).alias("frag"), F.size("combo").alias("subset_size"), F.array_join(t(lambda v: v["label"]), "_").alias("aa_bucket"), F.struct("subdir", "file", "line_no", "combo_no").alias("seq"), F.col("pdb_id").alias("source_id"),
        "cg_coords", t(lambda v: v["bb"]).alias("bb_coords"), t(lambda v: v["flank_seq"]).alias("flank_seqs"), t(lambda v: v["flank_ca"]).alias("flank_cas"),
        t(lambda v: F.struct(F.transform(v["h"], lambda a: a["c"]).alias("coords"), F.transform(v["h"], lambda a: a["name"]).alias("names"), F.transform(v["h"], lambda a: a["element"]).alias("elements"))).alias("vdm_heavy"),
        t(lambda v: F.struct(v["seg"].alias("seg"), v["chain"].alias("chain"), v["resnum"].alias("resnum"), v["resname"].alias("resname"))).alias("scrr"),
        "cg_names", "cg_elements", same(F.col("cg_s")).alias("cg_seg"), same(F.col("cg_c")).alias("cg_chain"), same(F.col("cg_r")).alias("cg_resnum"), "cg_resname",
    )
    return framed(out) if own_frame else out


def framed(records: DataFrame) -> DataFrame:
    """Records with all coordinates in the frame of the group's atoms; groups of two stay as they are."""

    def run(parts):
        for p in parts:
            p = p.copy()
            for i, cg in zip(p.index, p["cg_coords"]):
                x = np.array([np.asarray(a, float) for a in cg])
                if len(x) < 3:
                    continue
                axes, origin = local_frame(x)
                go = lambda v: in_frame(np.array([np.asarray(a, float) for a in v]), axes, origin).tolist()
                p.at[i, "cg_coords"] = go(cg)
                p.at[i, "bb_coords"] = [go(v) for v in p.at[i, "bb_coords"]]
                p.at[i, "flank_cas"] = [go(v) for v in p.at[i, "flank_cas"]]
                p.at[i, "vdm_heavy"] = [{"coords": go(h["coords"]), "names": list(h["names"]), "elements": list(h["elements"])} for h in p.at[i, "vdm_heavy"]]
            yield p

    return records.mapInPandas(run, records.schema)


def library_atoms(library: DataFrame) -> DataFrame:
    """Atoms of each library row: group, backbone and side chains, a backbone name once.

    Columns: the row's key, role (cg or vdm), residue, name, element, x, y, z.
    """
    key = ["frag", "subset_size", "aa_bucket", "cluster_id"]
    xyz = [F.col("c")[i].alias(n) for i, n in enumerate("xyz")]
    cg = library.select(*key, F.posexplode("cg_coords").alias("i", "c"), "cg_names", "cg_elements", "cg_seg", "cg_chain", "cg_resnum", "cg_resname").select(
        *key, F.lit("cg").alias("role"), F.col("i").alias("atom"), F.element_at("cg_seg", F.col("i") + 1).alias("seg"), F.element_at("cg_chain", F.col("i") + 1).alias("chain"), F.element_at("cg_resnum", F.col("i") + 1).alias("resnum"), F.element_at("cg_resname", F.col("i") + 1).alias("resname"),
        F.element_at("cg_names", F.col("i") + 1).alias("name"), F.coalesce(F.element_at("cg_elements", F.col("i") + 1), F.lit("C")).alias("element"), *xyz,
    )
    who = [F.col(f"s.{k}").alias(k) for k in ("seg", "chain", "resnum", "resname")]
    bb = library.select(*key, F.posexplode("bb_coords").alias("r", "b"), "scrr").select(*key, "r", F.element_at("scrr", F.col("r") + 1).alias("s"), F.posexplode("b").alias("i", "c"))
    names = F.array(*(F.lit(n) for n in FRAME_ATOMS))
    bb = bb.select(*key, F.lit("vdm").alias("role"), F.col("i").alias("atom"), *who, F.element_at(names, F.col("i") + 1).alias("name"), F.substring(F.element_at(names, F.col("i") + 1), 1, 1).alias("element"), *xyz)
    side = library.where("vdm_heavy is not null").select(*key, F.posexplode("vdm_heavy").alias("r", "h"), "scrr").select(*key, F.element_at("scrr", F.col("r") + 1).alias("s"), "h", F.posexplode("h.coords").alias("i", "c"))
    side = side.select(*key, F.lit("vdm").alias("role"), (F.col("i") + 3).alias("atom"), *who, F.element_at("h.names", F.col("i") + 1).alias("name"), F.coalesce(F.element_at("h.elements", F.col("i") + 1), F.lit("C")).alias("element"), *xyz)
    return cg.unionByName(bb).unionByName(side.where(~F.col("name").isin(*FRAME_ATOMS)))


def append_ligand(cg_atoms: DataFrame, parent_atoms: DataFrame, key: list[str]) -> DataFrame:
    """Parent ligand atoms beyond the group, moved into the library row's frame.

    Both tables: key, chain, resnum, name, x, y, z. Three or more shared atoms give the fit; with
    fewer, atoms come as they lie.
    """
    who = ["chain", "resnum", "name"]
    shared = cg_atoms.select(*key, *who, *(F.col(c).alias(f"lib_{c}") for c in "xyz"))
    j = parent_atoms.join(shared, [*key, *who], "left")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        both = p["lib_x"].notna()
        x = p[["x", "y", "z"]].to_numpy(float)
        if both.sum() >= 3:
            r, t, _ = superpose(x[both], p.loc[both, ["lib_x", "lib_y", "lib_z"]].to_numpy(float))
            x = x @ r[0] + t[0]
        out = p[[*key, *who]].copy()
        out[["x", "y", "z"]] = x
        return out[~both]

    f = {c.name: c.dataType.simpleString() for c in parent_atoms.schema.fields}
    return j.groupBy(*key).applyInPandas(run, ", ".join([*(f"`{c}` {f[c]}" for c in [*key, *who]), "x double, y double, z double"]))


def binding_site_combos(atoms: DataFrame, ligand: Column, radius: float = 4.5) -> DataFrame:
    """One or two residues with a protein atom near the ligand, each as its amino acid or backbone.

    Columns: pdb_id, bsr_combo, labels (sorted), aa_bucket, subset_size, q_bb in the labels' order.
    """
    lig = atoms.where(ligand)
    near = J.radius_join(lig.select("pdb_id", "x", "y", "z"), protein(atoms.where(~ligand)).select(*RES, "x", "y", "z"), radius, ("pdb_id",))
    site = near.select("pdb_id", *(F.col(f"{c}_r").alias(c) for c in RES[1:])).distinct().join(backbones(atoms), RES)
    site = site.withColumn("o", F.row_number().over(Window.partitionBy("pdb_id").orderBy("seg", "chain", "resnum")))
    r = F.struct("o", "seg", "chain", "resnum", "resname", "bb")
    one = site.select("pdb_id", F.array(r).alias("rs"))
    a, b = site.select("pdb_id", r.alias("a")), site.select("pdb_id", r.alias("b"))
    two = a.join(b, "pdb_id").where("a.o < b.o").select("pdb_id", F.array("a", "b").alias("rs"))
    c = one.unionByName(two)
    pick = lambda i: F.when(F.col("rs")[i]["resname"] == "GLY", F.array(F.lit(BACKBONE_LABEL))).otherwise(F.array(F.col("rs")[i]["resname"], F.lit(BACKBONE_LABEL)))
    c1 = c.where(F.size("rs") == 1).select("*", F.explode(pick(0)).alias("l0")).select("pdb_id", "rs", F.array("l0").alias("ls"))
    c2 = c.where(F.size("rs") == 2).select("*", F.explode(pick(0)).alias("l0")).select("*", F.explode(pick(1)).alias("l1")).select("pdb_id", "rs", F.array("l0", "l1").alias("ls"))
    v = c1.unionByName(c2).withColumn("z", F.array_sort(F.zip_with("ls", "rs", lambda l, x: F.struct(l.alias("l"), x["o"].alias("o"), x["bb"].alias("bb")))))
    name = F.array_join(F.transform("rs", lambda x: F.concat_ws(":", F.coalesce(x["seg"], F.lit("")), x["chain"], x["resnum"].cast("string"))), ";")
    labels = F.transform("z", lambda x: x["l"])
    return v.select("pdb_id", name.alias("bsr_combo"), labels.alias("labels"), F.array_join(labels, "_").alias("aa_bucket"), F.size("rs").alias("subset_size"), F.transform("z", lambda x: x["bb"]).alias("q_bb"))


def graph_nodes(atoms: DataFrame, ligand_resname: str = "LIG") -> DataFrame:
    """Node table of a binding site: number, charge, hydrogens near, aromaticity, protein flag, position.

    Hydrogens of an atom are those within 1.1. Charges come from a column `charge` if there is one.
    """
    from ..functions.chem import NUMBER

    heavy = heavy_atoms(atoms)
    h = atoms.where(F.col("element").isin("H", "D"))
    near = J.radius_join(h.select("pdb_id", "x", "y", "z"), heavy.select("pdb_id", "serial", "x", "y", "z"), 1.1, ("pdb_id",)).groupBy("pdb_id", F.col("serial_r").alias("serial")).agg(F.count("*").alias("num_hs"))
    number = F.create_map(*(F.lit(x) for kv in NUMBER.items() for x in kv))[F.initcap("element")]
    aromatic = F.col("resname").isin(*AROMATIC_RESIDUES) & F.col("name").isin(*AROMATIC_ATOMS)
    n = heavy.join(near, ["pdb_id", "serial"], "left")
    return n.select(
        F.col("pdb_id").alias("graph_id"), (F.row_number().over(Window.partitionBy("pdb_id").orderBy("serial")) - 1).alias("node_id"), number.cast("float").alias("atomic_num"),
        (F.col("charge") if "charge" in atoms.columns else F.lit(0.0)).cast("float").alias("charge"), F.coalesce("num_hs", F.lit(0)).cast("float").alias("num_hs"), F.lit(0.0).cast("float").alias("hybridization"), aromatic.cast("float").alias("aromatic"),
        (F.col("resname") != ligand_resname).cast("float").alias("is_protein"), *(F.col(c).cast("float").alias(c) for c in "xyz"), F.concat_ws(":", "chain", "resnum", "resname").alias("residue_label"), F.col("pdb_id").alias("source"),
    )


def graph_edges(nodes: DataFrame, most: float = 1.8) -> DataFrame:
    """Edges of atoms closer than 1.8, both ways; bond type unknown (0), covalent."""
    e = J.bond_pairs(nodes.where("is_protein = 1").withColumnRenamed("graph_id", "pdb_id"), most)
    return e.select(F.col("pdb_id").alias("graph_id"), "src", "dst", F.lit(0.0).cast("float").alias("bond_type"), F.lit(1.0).cast("float").alias("is_covalent"))


def ligand_edges(nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """Edges of the ligand atoms with the bond codes of its template, both ways.

    nodes: graph_nodes. templates: graph_id and smiles. Atoms are bonded by distance, then the
    template's bond orders are laid on them; where it doesn't fit the code is 0.
    """
    from ..functions import chem
    from .ligands import mol_of

    kind = "graph_id string, src int, dst int, bond_type float, is_covalent float"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node_id")
        mol = mol_of([chem.ELEMENTS[int(n) - 1] for n in p["atomic_num"]], p[["x", "y", "z"]].to_numpy(float))
        code = {1.0: 1, 2.0: 2, 3.0: 3, chem.AROMATIC: 4}
        try:
            template = chem.parse_smiles(p["smiles"].iloc[0] or "")
            bonds = [(i, j, code.get(o, 0)) for i, j, o in chem.with_template_orders(mol, template.part(template.heavy())).bonds]
        except (chem.SmilesError, IndexError):
            bonds = [(i, j, 0) for i, j, _ in mol.bonds]
        ids = p["node_id"].tolist()
        rows = [(p["graph_id"].iloc[0], ids[a], ids[b], float(o), 1.0) for i, j, o in bonds for a, b in ((i, j), (j, i))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    return nodes.where("is_protein = 0").join(templates.select("graph_id", "smiles"), "graph_id", "left").groupBy("graph_id").applyInPandas(run, kind)


def group_contact_table(contacts: DataFrame, matches: DataFrame, precedence: DataFrame, aa_codes, allowed_types: list[str] | None = None) -> DataFrame:
    """One row for each match, touched chain and residue name: precedence score and contacts.

    With allowed_types, matches must touch something other than an amino acid, all of it of these types.
    """
    c = J.contact_atoms(contacts, matches)
    group = ["probe_name", "chain1", "resnum1", "match_no"]
    if allowed_types is not None:
        c = J.required_contacts(c, aa_codes, allowed_types, tuple(group))
    c = c.where(F.col("resname2").isin(*aa_codes)).join(F.broadcast(precedence), "atomtype2")
    ids = c.select("probe_name", "orig_chain2").distinct().withColumn("prot_chain_cluster", F.row_number().over(Window.partitionBy("probe_name").orderBy("orig_chain2")) - 1)
    g = c.groupBy(*group, "orig_chain2", "resname2").agg((-F.sum("precedence")).cast("double").alias("score"), F.count("*").alias("contacts"))
    return g.join(ids, ["probe_name", "orig_chain2"])
