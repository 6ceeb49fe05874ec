"""Enrichment, scores, pivots and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AA_CODES, BACKBONE_LABEL, aa_reference, mean_aa_size


def not_backbone(bucket: Column) -> Column:
    return ~F.array_contains(F.split(bucket, "_"), BACKBONE_LABEL)


def bucket_counts(library: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """Clusters (rows) of each bucket without a backbone label."""
    return library.where(not_backbone(F.col(bucket))).groupBy(bucket).agg(F.count("*").cast("bigint").alias("n"))


def _mean(norm: str) -> float | None:
    if norm not in ("none", "unweighted", "bg_weighted"):
        raise ValueError(f"unknown normalisation {norm!r}")
    return None if norm == "none" else mean_aa_size(norm == "bg_weighted")


def _enrichment(counts: DataFrame, size: Column, background: Column, mean: float | None, label: str) -> DataFrame:
    """ln(observed / expected) where both are positive. counts has n and total."""
    observed = F.col("n") if mean is None else F.col("n") / size
    expected = F.col("total") * background / F.lit(mean or 1.0)
    good = counts.withColumn("o", observed.cast("double")).withColumn("e", expected).where((F.col("o") > 0) & (F.col("e") > 0))
    return good.select(label, F.ln(F.col("o") / F.col("e")).alias("enrichment"))


def _with_total(counts: DataFrame) -> DataFrame:
    """The total of all counts beside each: one row, broadcast by its size of one."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))


def single_enrichment(counts: DataFrame, norm: str = "bg_weighted", bucket: str = "aa_bucket") -> DataFrame:
    """Enrichment of single amino acids over the background; the total includes unknown ones."""
    ref = F.broadcast(aa_reference(counts.sparkSession).withColumnRenamed("aa", bucket))
    return _enrichment(_with_total(counts).join(ref, bucket), F.col("heavy_atoms"), F.col("bg_freq"), _mean(norm), bucket)


def pair_enrichment(counts: DataFrame, norm: str = "bg_weighted", bucket: str = "aa_bucket") -> DataFrame:
    """Enrichment of amino acid pairs; unequal ones are expected in both orders."""
    ref = aa_reference(counts.sparkSession)
    one, two = (F.broadcast(ref.select(F.col("aa").alias(f"aa{i}"), F.col("heavy_atoms").alias(f"s{i}"), F.col("bg_freq").alias(f"f{i}"))) for i in (1, 2))
    parts = F.split(bucket, "_")
    c = _with_total(counts).where(F.size(parts) == 2).withColumn("aa1", parts[0]).withColumn("aa2", parts[1]).join(one, "aa1").join(two, "aa2")
    mean = _mean(norm)
    times = F.when(F.col("aa1") == F.col("aa2"), 1.0).otherwise(2.0)
    return _enrichment(c, F.col("s1") + F.col("s2"), times * F.col("f1") * F.col("f2"), None if mean is None else 2 * mean, bucket)


def label_marginals(pairs: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """Sum of each label's pair values, a pair of equal labels once, and its rank."""
    each = pairs.select(F.explode(F.array_distinct(F.split(bucket, "_"))).alias("label"), "enrichment")
    s = each.groupBy("label").agg(F.sum("enrichment").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "label")).cast("bigint"))


def matrix_long(pairs: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """aa1, aa2, value in both directions."""
    p = pairs.select(F.split(bucket, "_")[0].alias("aa1"), F.split(bucket, "_")[1].alias("aa2"), F.col("enrichment").alias("value"))
    return p.unionByName(p.where("aa1 != aa2").select(F.col("aa2").alias("aa1"), F.col("aa1").alias("aa2"), "value"))


def matrix(pairs: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """One row and column per label, NaN where a pair is missing."""
    wide = matrix_long(pairs, bucket).groupBy("aa1").pivot("aa2", list(AA_CODES)).agg(F.first("value"))
    return wide.select("aa1", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in AA_CODES))


def profile_similarity(one: DataFrame, two: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """Correlation of two profiles over the labels that both have."""
    j = one.select(bucket, F.col("enrichment").alias("a")).join(two.select(bucket, F.col("enrichment").alias("b")), bucket)
    return j.agg(F.corr("a", "b").alias("correlation"), F.count("*").alias("labels"))


def hit_pivot(hits: DataFrame, frags: list[str], sample: str = "sample", frag: str = "frag") -> DataFrame:
    """Hits of each sample by fragment, absent ones 0, with a total, and a last row of averages."""
    wide = hits.groupBy(sample).pivot(frag, frags).agg(F.count(F.lit(1))).na.fill(0).select(sample, *(F.col(f).cast("double").alias(f) for f in frags))
    total = sum((F.col(f) for f in frags), F.lit(0.0))
    body = wide.withColumn("total", total).withColumn("is_average", F.lit(False))
    mean = body.agg(*(F.bround(F.avg(c), 2).alias(c) for c in [*frags, "total"])).select(F.lit("Average").alias(sample), *frags, "total", F.lit(True).alias("is_average"))
    return body.unionByName(mean)


def counted_grid(hits: DataFrame, samples: DataFrame, sample: str = "sample", frag: str = "frag", weight: Column | None = None) -> DataFrame:
    """Weighted hits of every sample and every fragment that has any, zeros included.

    The grid is samples by fragments: an answer of that size, not an intermediate of hits.
    """
    counts = hits.groupBy(sample, frag).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("v"))
    frags = counts.groupBy(frag).agg(F.sum("v").alias("s")).where("s > 0").select(frag)
    return samples.select(sample).distinct().join(frags, how="cross").join(counts, [sample, frag], "left").select(sample, frag, F.coalesce("v", F.lit(0.0)).alias("v"))


def pose_scores(grid: DataFrame, sample: str = "sample", frag: str = "frag") -> DataFrame:
    """Mean over fragments of hits relative to the fragment's mean over all poses."""
    mean = grid.groupBy(frag).agg(F.avg("v").alias("m"))
    return grid.join(mean, frag).groupBy(sample).agg(F.avg(F.try_divide("v", "m")).alias("score"))


def log_odds_scores(grid: DataFrame, sample: str = "sample", frag: str = "frag", eps: float = 1e-12) -> DataFrame:
    mean = grid.groupBy(frag).agg(F.avg("v").alias("m"))
    return grid.join(mean, frag).groupBy(sample).agg(F.sum(F.ln((F.col("v") + eps) / (F.col("m") + eps))).alias("score"))


def size_weight(size: Column, single: float = 0.5) -> Column:
    return F.when(size == 1, single).otherwise(1.0)


def rank_rollup(ranks: DataFrame, group: list[str]) -> DataFrame:
    """How often the true pose ranks first or second, third, and either."""
    r = F.col("rank")
    return ranks.groupBy(*group).agg(F.sum(F.when(r <= 2, 1).otherwise(0)).alias("top2"), F.sum(F.when(r == 3, 1).otherwise(0)).alias("third"), F.sum(F.when(r <= 3, 1).otherwise(0)).alias("total"))


def qualifying_groups(members: DataFrame, group: list[str], member: str, least: int = 80) -> DataFrame:
    """Groups with at least so many distinct members."""
    return members.groupBy(*group).agg(F.countDistinct(member).cast("bigint").alias("n")).where(F.col("n") >= least)


def ligands_with_many_groups(members: DataFrame, frag: str, member: str, counts: DataFrame, least_groups: int = 3, least_vdgs: int = 2500) -> DataFrame:
    """Members of several groups that each have enough clusters of two residues. counts: frag, n."""
    good = counts.where(F.col("n") >= least_vdgs).select(frag)
    return members.join(good, frag, "left_semi").groupBy(member).agg(F.countDistinct(frag).cast("bigint").alias("groups")).where(F.col("groups") >= least_groups)


def status_counts(rows: DataFrame, status: Column) -> DataFrame:
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def library_totals(library: DataFrame, group: list[str]) -> DataFrame:
    """Clusters and members of the library by group."""
    return library.groupBy(*group).agg(F.count("*").alias("clusters"), F.sum("cluster_size").cast("bigint").alias("members"))


def precedence_scores(contacts: DataFrame, precedence: DataFrame, group: list[str], kind: str) -> DataFrame:
    """Minus the sum over contact kinds of their number times the kind's precedence."""
    return contacts.join(precedence, kind).groupBy(*group).agg((-F.sum("precedence")).alias("score"))


def run_statistics(table: DataFrame) -> DataFrame:
    """Distinct ligand instances, structures and ligands of a contact table."""
    return table.agg(F.countDistinct("probe_name", "lig_resnum").alias("instances"), F.countDistinct("probe_name").alias("structures"), F.countDistinct("lig_resname").alias("ligands"))


def centroids(atoms: DataFrame, group: list[str]) -> DataFrame:
    return atoms.groupBy(*group).agg(*(F.avg(c).alias(c) for c in "xyz"))
