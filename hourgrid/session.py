"""Session settings the library relies on."""
from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plan quality, independent of cluster size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "hourgrid", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own master and sizes."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Make sure checkpoints go to the shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only in local mode, where there is no other machine that would have to read it; a
    cluster without the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="hourgrid-")
    context.setCheckpointDir(shared)


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` for use in several branches of a plan, worked out only once.

    It is written to the checkpoint folder, so a lost executor costs a read and not another scan of the facts.
    """
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which import it when they unpack our functions; once per application."""
    context = spark.sparkContext
    if getattr(context, "_hourgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='hourgrid-ship-')}/hourgrid", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._hourgrid_shipped = True
