"""Session helpers: a local session for tests, table reading and shared scratch space."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: dict[str, str] = {}


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession) -> str:
    """The folder for what this application materialises; removed by release(), at the latest when the driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _SCRATCH:
        _SCRATCH[name] = os.path.join(checkpoint_root(spark), f"lodestone-{name}")
        atexit.register(release, spark)
    return _SCRATCH[name]


def release(spark: SparkSession) -> None:
    """Remove what this application has materialised; call it when the results of its queries are written."""
    try:
        path = _SCRATCH.pop(spark.sparkContext.applicationId, None)
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended before  # noqa: BLE001
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = os.path.join(scratch(df.sparkSession), uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
