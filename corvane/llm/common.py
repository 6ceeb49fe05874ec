"""Reading inputs, the shared scratch folder and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only in a local session without it (tests) a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again (columns can be pruned)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_table(df: DataFrame) -> None:
    """Remove a table of written() that nothing will read again."""
    files = df.inputFiles()
    if files:
        forget(df.sparkSession, files[0].rpartition("/")[0])


def fixed_splits(spark: SparkSession) -> None:
    """Make scans of one table split alike from now on, even if executors come and go meanwhile.

    Row places (monotonically_increasing_id) of two scans can then be compared. Splits otherwise
    depend on the cores that are registered when a scan is planned.
    """
    name = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(max(2, spark.sparkContext.defaultParallelism)))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less its columns of these names, in any case: an operator's own columns take their place."""
    own = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in own))


def crc_bucket(doc_id, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))

