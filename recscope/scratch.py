"""Scratch tables in the folder that driver and executors share.

All tables of an application lie in one folder of its own there; ``clear`` deletes it once the application's results have been written or shown.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder of our own on a single machine, and an error on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="recscope-")
    return f"file://{_own_dirs[app]}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    """The application's folder."""
    return f"{shared_dir(spark)}/recscope-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's scratch tables, journals and checkpoints; frames that read them can no longer be computed."""
    system, at = fs.FileSystem.from_uri(own_dir(spark)) if "://" in own_dir(spark) else (fs.LocalFileSystem(), own_dir(spark).removeprefix("file:"))
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it read back: lineage is cut there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
