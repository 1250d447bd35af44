"""Session defaults, the shared work folder, and shipping this package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", app: str = "quernal", **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them."""
    return SparkSession.builder.master(master).appName(app).config(map={**DEFAULTS, **conf}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`.

    Only a session without executors of its own (master `local...`) may go without that setting; it then
    gets a temporary folder. On a cluster the lack of it is an error rather than a machine-local folder.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if known:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(known)
        return known
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quernal-")
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets the driver find out now which shuffles and checkpoints nothing refers to any more, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], stem: str) -> str:
    """A column name that isn't among `columns`, whatever its case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quernal_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="quernal-zip-"), "quernal_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(out)
    context._quernal_shipped = True


#: Tables under so many bytes aren't worth a shuffle.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table lies in fewer splits than that: one row group of Parquet is one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in `folder`."""
    ship(spark)
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
