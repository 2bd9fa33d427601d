"""Versioned table snapshots: a new version is written whole, then becomes current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """Folder with `v=<n>` versions; a version counts once its commit row is written.

    Readers take the highest committed version, so a job lost half-way leaves the old one in
    place. Nothing reads and overwrites the same path.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[int]:
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        found = []
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
            if name.startswith("v=") and fs.exists(done):
                found.append(int(name[2:]))
        return sorted(found)

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={done[-1]}") if done else None

    def write(self, df: DataFrame) -> int:
        done = self.versions()
        version = (done[-1] + 1) if done else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version
