"""Places and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local session gets a temporary folder; on a cluster this raises, as no
    folder of one machine is seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        where = tempfile.mkdtemp(prefix="gridproof-")
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else f"file://{where}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own, in the application's folder; the folder can go when the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/gridproof-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As written, as a table of the session in buckets of the keys: tables with as many buckets are joined and grouped by these keys without a shuffle. forget() takes it out of the catalog."""
    path = new_path(df.sparkSession, name)
    table = f"gridproof_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    found = df.sparkSession.table(table)
    found.bucketed_table = table
    return found


def forget(*tables: DataFrame) -> None:
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE {t.bucketed_table}")  # the files stay, as those of written do


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    instead_of: an earlier result of this function that nothing needs any more once this one is written; its files are deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    if instead_of is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of.written_path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return table
