"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import granary

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile larger methods; wide rows of parsed text hit this.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Session key that names the shared folder where it is not the checkpoint folder.
SHARED_KEY = "granary.shared.dir"

_written: list[tuple[SparkSession, str]] = []
_releases = [0]


def configure(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply the settings; helpers travel to the workers inside the tasks.

    `folder` is where intermediate tables go, if not to spark.checkpoint.dir. It
    must be one that the driver and all executors see.
    """
    cloudpickle.register_pickle_by_value(granary)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if folder:
        spark.conf.set(SHARED_KEY, folder)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder given to `configure`, else the one in spark.checkpoint.dir.

    Where neither is named, a scratch folder serves a local master, and a folder
    in the warehouse serves a cluster, unless the warehouse is a path of each
    machine's own disk: then nothing is shared and this raises an error.
    """
    folder = spark.conf.get(SHARED_KEY, None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="granary-")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")):
            raise ValueError(
                "no shared folder: set spark.checkpoint.dir, or give configure() a folder that all executors see"
            )
        folder = f"{warehouse.rstrip('/')}/granary"
    spark.conf.set(SHARED_KEY, folder)
    return folder


def releases() -> int:
    """How often tables were deleted so far; what was kept before the last time is gone."""
    return _releases[0]


def release(spark: SparkSession) -> None:
    """Delete the tables `materialize` wrote in this session; frames on them end with it."""
    _releases[0] += 1
    context = spark.sparkContext
    for entry in [e for e in _written if e[0] is spark]:
        path = context._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(entry)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)


def heavy_tasks(spark: SparkSession) -> int:
    """How many tasks to use where few rows carry much work.

    Adaptive execution sizes stages by bytes and would put model fits on small
    rows into one task.
    """
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def materialize(df: DataFrame) -> DataFrame:
    """Write a reduced table once to the shared folder and go on from there.

    Cuts the lineage, survives lost executors, and lets several later steps read
    the same rows without repeating the work that made them. `release`, or the
    end of the program, deletes the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/granary-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
