"""Session helpers: a local session for tests, the shared folder, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session on this machine, for tests and the benchmark; shared: its ``spark.checkpoint.dir``, if any."""
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only on one machine, as in tests, may that be unset; a folder
    of the machine then takes its place. On a cluster an unset folder is an error: each executor would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, on whatever file system."""
    fs, path = _at(spark, folder)
    return fs.exists(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI of a folder, for readers other than Spark."""
    fs, path = _at(spark, folder)
    at = fs.makeQualified(path).toUri().toString()
    return "file://" + at.removeprefix("file:") if at.startswith("file:/") and not at.startswith("file://") else at


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    fs, path = _at(spark, folder)
    fs.delete(path, True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost executor costs a re-read only. In ``folder``
    tables can be removed together."""
    at = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
