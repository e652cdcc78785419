"""Session factory and table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; an existing session is reused as it is.

    Nothing here caps parallelism: AQE coalesces small shuffle partitions and splits skewed ones, so
    ``spark.sql.shuffle.partitions`` only has to be large enough for the largest input.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session when it is set.

    Only in local mode (tests, a laptop) a local folder is made and registered where the setting is absent; on a cluster,
    whose nodes could not read each other's folders, that is an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(known)
        return known
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all nodes of the cluster share")
    own = tempfile.mkdtemp(prefix="sparkloom-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once as a compressed table in the shared checkpoint folder and read back.

    Cuts the lineage as a checkpoint does, for intermediate results that several branches read; any executor can read it
    again when another is lost. Unlike a checkpoint it keeps no partitioning and is columnar. Results read the tables
    lazily, so that they stay until ``release`` is called or the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` wrote. Call it once the results that read them are written."""
    while _written:
        path = _written.pop()
        try:
            file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        except Exception:  # the session is gone, and with it the way to the folder
            return


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as the cluster has cores, for work that costs far more than moving its
    input; only an input of fewer splits than cores (a small table in one row group) is dealt out anew."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
