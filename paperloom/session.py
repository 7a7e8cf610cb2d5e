"""Session helpers: tables, shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def build_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is written for.

    On a cluster the session comes from outside and none of this is called.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperloom")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for a context: they import its
    functions, whatever their own path is."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="paperloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "paperloom-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    context.addPyFile(path)
    context._paperloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names
    one; where it is unset, a temporary folder in local mode and an error elsewhere, since
    executors of a cluster would each write to their own disk."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder, in folders by a column if one is
    named, and read it back.

    The table survives the loss of executors, is columnar and compressed, and its size
    is known to the planner afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    (df.repartition(partition_by).write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Tables of a session go with it."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before; a shared folder is cleaned as a whole
        pass


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder is a parameter (environment
    variable ``PAPERLOOM_TOKENIZERS``) and nothing is copied into this repository."""
    return os.path.join(os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers"), name)
