"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "tiersmith", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` keys use ``_`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once, so that its functions run wherever the driver was started.

    ``cut_lineage`` and the driver queries call it, so sessions made elsewhere have it, too.
    """
    package = pathlib.Path(__file__).resolve().parent
    folder = pathlib.Path(SparkFiles.getRootDirectory(), "package")
    if folder.exists():
        return
    folder.mkdir(parents=True)
    archive = shutil.make_archive(str(folder / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for durable intermediate data; one of this process only in local mode."""
    sc = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tiersmith-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def intermediates(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/tiersmith-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what the application's lineage cuts have written; for the end of a job, when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back as a new root.

    The copy outlives lost executors, so iterative jobs never replay earlier rounds, and
    later passes read only the columns they use.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{intermediates(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
