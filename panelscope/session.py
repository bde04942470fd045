"""Session construction and lineage handling."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume; everything else is left to the cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # files of checkpoints whose tables are gone are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "panelscope", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, pass the cluster's
    own session to the operators instead."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PANELSCOPE_DRIVER_MEMORY", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster has to set it to shared storage: without it this raises, as
    executors would write to folders that nobody else sees. Only where driver
    and executors are one process (``local`` masters, as in tests) a scratch
    folder serves, which is deleted when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver "
                               "and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="panelscope-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: Spark's setting that deletes the shuffle files of a table's own job when the job is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Tables made inside and written as a whole leave no shuffle files: these are
    deleted when the job is done, not when the driver's garbage collection comes by."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder. What was shuffled to make it is
    deleted at once: of a chain of stages only one's shuffles lie on disk."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as packed columns in the shared checkpoint folder, without the shuffles
    that made it; ``forget`` deletes it."""
    spark = df.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.select("*").write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
