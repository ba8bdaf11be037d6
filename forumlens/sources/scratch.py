"""Tables that a job writes on the way and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='forumlens-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/forumlens-{kind}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Staged tables of one job: each cuts lineage and survives lost executors; `clear` deletes them.

    with Scratch(spark) as s: a = s.staged(df, "a") ... keeps what `s.keep` names, and deletes the rest at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{new_folder(self.spark, 'scratch')}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.made.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            found = self.made.pop(id(df), None)
            if found:
                remove(self.spark, found[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in list(self.made.values())))


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables, indexes and stores of queries; call it once their results are written."""
    for kind in ("scratch", "index", "store"):
        remove(spark, f"{shared_folder(spark)}/forumlens-{kind}")
