"""Session helpers: a local session for tests and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "orrery", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from the caller."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in spark.checkpoint.dir.

    Only a local master, as in tests, gets a temporary folder of its own where none is named; a cluster without one is an error, as its executors
    share no temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there. Survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *sort: str) -> DataFrame:
    """`df` as a table in the shared folder, sorted within its files so that their statistics prune: for what is read often, by few columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffle files of frames that are no longer held are deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
