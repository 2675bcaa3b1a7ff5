"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only in local mode, where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="searchlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and survive executors.

    ``write`` stores a DataFrame as Parquet and returns a DataFrame that reads it; the shuffle
    files of what it ran are deleted with its end (a setting of Spark), as only the table is read
    from then on. ``drop`` deletes tables that no later plan reads. What is still there is deleted
    when the driver ends, as lazily evaluated results may read it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session is already gone
            pass


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of our own that no column of df has."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{s}".lower() in taken for s in stems):
        mark += "_"
    return [f"{mark}{s}" for s in stems]


def sample_rows(docs: DataFrame, id_col: str, text_col: str, rows: int, *, known: DataFrame | None = None) -> DataFrame:
    """(__id, __text, ...): at most so many distinct (id, text) rows, those with the smallest hashes,
    spread over the session's default parallelism. known: columns by __id that chosen rows need to have."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")).where("__id is not null").withColumn("__h", F.xxhash64("__text"))
    keys = keyed.select("__id", "__h").distinct()
    if known is not None:
        keys = keys.join(known, "__id")
    keys = keys.orderBy(F.xxhash64("__id", "__h"), "__id", "__h").limit(rows)
    found = keyed.join(F.broadcast(keys), ["__id", "__h"])
    others = [c for c in keys.columns if c not in ("__id", "__h")]
    once = found.groupBy("__id", "__h").agg(*[F.first(c).alias(c) for c in ("__text", *others)])
    return once.repartition(docs.sparkSession.sparkContext.defaultParallelism, "__id", "__h").drop("__h")
