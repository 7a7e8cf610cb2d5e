"""The index store: typed tables in a folder instead of pickles and a key-value database."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ModelMismatch(ValueError):
    """Vectors were made by another model than the one asked for."""


class Store:
    """Tables of an index under one folder. Each version of a table is a folder of its own, and
    a pointer file names the one that counts. It is switched by one rename, so a reader
    sees the old table or the new one, and a failed write leaves the old one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.getFileSystem(conf).getUri(), conf)

    def folder(self, name: str) -> str | None:
        """Where the current version of a table lies; None without any."""
        jvm, fs, _ = self._fs()
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current/{name}")
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            return f"{self.path}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def _switch(self, name: str, version: str) -> None:
        jvm, fs, context = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        before, fresh = self.folder(name), path(f"{self.path}/_current/.{version}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(fresh), fs.makeQualified(path(f"{self.path}/_current/{name}")), options)
        if before:
            fs.delete(path(before), True)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """A new version of a table; what it was made from may be the version before."""
        version = f"{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.path}/{version}")
        self._switch(name, version)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.folder(name))

    def read(self, name: str) -> DataFrame:
        folder = self.folder(name)
        if folder is None:
            raise FileNotFoundError(f"{self.path} has no table {name}")
        return self.spark.read.parquet(folder)

    def is_built(self, name: str = "chunks") -> bool:
        return self.folder(name) is not None

    def count(self, name: str = "chunks") -> int:
        return self.read(name).count()

    def get(self, key, name: str = "chunks", column: str = "chunk_id") -> DataFrame:
        """One record; the filter reaches the scan."""
        return self.read(name).where(F.col(column) == F.lit(key))

    def get_many(self, keys: DataFrame, name: str = "chunks", column: str = "chunk_id") -> DataFrame:
        """Records of keys (column, pos) in the order of pos; missing ones are left out."""
        return self.read(name).join(keys, column).orderBy("pos")

    def upsert(self, fresh: DataFrame, name: str = "chunks", column: str = "chunk_id", version: str = "version") -> None:
        """The latest version of each key, old and new."""
        self.write(name, latest(self.read(name).unionByName(fresh), column, version) if self.is_built(name) else latest(fresh, column, version))

    def write_model(self, backend: str, model: str, dims: int) -> None:
        self.write("meta", self.spark.createDataFrame([(backend, model, dims)], "backend string, model string, dims int"))

    def check_model(self, model: str, dims: int) -> None:
        """The saved model wins: another one's vectors live in another space."""
        saved = self.read("meta").first()
        if saved is None or (saved["model"], saved["dims"]) != (model, dims):
            raise ModelMismatch(f"the index was built by {saved}, not {model} with {dims} dimensions")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Each key's row of the greatest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
