"""Session helpers: one place for the engine's Spark settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def get_spark(master: str | None = None, app: str = "domquarry", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with AQE, Arrow and UTC; the web UI stays off."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions",
                 str(shuffle_partitions or os.environ.get("DQ_SHUFFLE_PARTITIONS") or cpus))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is only read here; without
    it that is an error.  In local mode a fresh folder is made when it is unset.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        spark.sparkContext.setCheckpointDir(given)
        return given
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="domquarry-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df):
    """Cut lineage at a stage boundary: write ``df`` to the shared checkpoint
    folder (``spark.checkpoint.dir``) and continue from the written copy.

    Keeps later plans small (a reused intermediate is not re-planned and
    re-run by every branch that reads it) and survives executor loss, unlike
    a local checkpoint.  The partitioning of ``df`` is kept."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def engine_defaults(spark: SparkSession) -> None:
    """For sessions that the engine did not make: page-level joins may reuse
    the node table's partitioning by ``page_id``."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def local_defaults(spark: SparkSession) -> None:
    """Local mode only: when ``spark.sql.shuffle.partitions`` was never set
    (still Spark's built-in 200), use one partition per core.  Cluster
    sessions and explicitly configured values are left alone; results do not
    depend on this setting, only task counts do."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    if sc.getConf().contains("spark.sql.shuffle.partitions"):
        return
    if spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
