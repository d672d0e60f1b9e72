"""Session defaults for the engine."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine wants of a session; the cluster's own settings for memory, cores and shuffle partitions stand beside it.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, app: str = "lintquarry", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys have underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a session, whatever their own search path is."""
    sc = spark.sparkContext
    if getattr(sc, "_lintquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lintquarry-")) / "lintquarry_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._lintquarry_shipped = True


def shared_dir(spark) -> str:
    """The folder that the cluster names for intermediate tables; an own one only where none is named and everything runs on this
    machine."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lintquarry-checkpoint-"))
    return (sc.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir().get()).rstrip("/")


def checkpointed(df):
    """df with its lineage cut, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df, *partition_by: str):
    """df written to the shared folder and read from there, for what several plans read; it goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
