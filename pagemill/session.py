"""Session factory and the settings that the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "pagemill", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. A temporary folder of this machine is taken only by a local
    session, where all tasks see it; elsewhere a folder must be named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagemill-checkpoint-"))


def shared_path(spark: SparkSession, name: str, fresh: bool = False) -> str:
    """A path within the shared checkpoint folder; a new one each time if `fresh`."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    # Spark makes a folder of its own for each session in the one that is named; what sessions share lies beside these.
    return f"{folder}/{name}-{uuid.uuid4().hex}" if fresh else f"{os.path.dirname(folder)}/{name}"


def stored_table(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new table of the shared folder: packed, and read by columns, unlike a checkpoint."""
    path = shared_path(rows.sparkSession, name, fresh=True)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate rows from whatever file system it lies on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def make_importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package from wherever the driver was started.

    On a cluster the package is shipped with --py-files or installed, and the extra entry of the path is never met.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
