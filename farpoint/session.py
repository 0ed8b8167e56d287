"""Session helpers: shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so a missing setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="farpoint-")
    return _local_scratch[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where two readers must see one and the same outcome (a range partitioning, say) and
    where a loop would otherwise grow its lineage. The copy survives lost executors and is
    columnar, so later readers still prune columns. Drop it with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the written tables of this session's scratch folder that ``df`` reads."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{root.split(':', 1)[-1]}/" in folder:
            delete_folder(spark, folder)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, fs = _path(spark, folder)
    return fs.exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    path, fs = _path(spark, folder)
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
