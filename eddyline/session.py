"""Session set-up and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes with the last plan that reads it
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session without it gets a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="eddyline-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """The same rows read back from the shared checkpoint folder, so that a lost executor costs no recomputation.

    keep_partitioning: later plans see how the rows are partitioned and do not shuffle them again; adaptive plans hide that, so this one is planned without, in a copy of the session, so
    that other queries keep theirs."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    aside = spark._jsparkSession.cloneSession()
    aside.conf().set("spark.sql.adaptive.enabled", "false")
    datasets = spark._jvm.org.apache.spark.sql.classic.Dataset
    kept = datasets.ofRows(aside, df._jdf.queryExecution().analyzed()).checkpoint(True)
    return DataFrame(datasets.ofRows(spark._jsparkSession, kept.queryExecution().analyzed()), spark)


def cut_each(dfs: list[DataFrame]) -> list[DataFrame]:
    """cut_lineage() of tables that do not depend on each other, all at a time."""
    if len(dfs) < 2:
        return [cut_lineage(df) for df in dfs]
    with ThreadPoolExecutor(len(dfs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(dfs[0].sparkSession)(cut_lineage), df) for df in dfs]]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_eddyline_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="eddyline-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # it is served from here as long as the application runs
        shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/tree"))
        context._eddyline_shipped = True
