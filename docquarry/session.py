"""Session settings and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docquarry")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset (tests)
    a fresh folder per application is made, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="docquarry-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_LOCAL = threading.local()  # each thread deletes its own stages


def _scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[list[str]]:
    """Stages that ``cut`` writes inside this block are deleted at its end; for
    jobs that have written all their results by then. The block gets the list of
    their paths; what it takes out of it stays."""
    mine: list[str] = []
    _scopes().append(mine)
    try:
        yield mine
    finally:
        _scopes().pop()
        for path in mine:
            delete_path(spark, path)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """End the lineage: write to the shared folder and read back. Survives the
    loss of executors, and branches after it do not compute their input twice."""
    path = fresh_path(df.sparkSession, name)
    if _scopes():
        _scopes()[-1].append(path)
    df.write.parquet(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    stage._cut_path = path
    return stage


def discard(stage: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``stage``, once all that reads it is written itself."""
    delete_path(stage.sparkSession, stage._cut_path)


def release(df: DataFrame) -> None:
    """Let Spark find that finished stages are not needed any more and delete
    their shuffle files now, not at some later collection of the driver's garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of few splits (one small file is one task). A
    scan that already has a split per core is left as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)  # round robin: no key can make it uneven


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, once per application: Python functions are
    sent by name, and only the driver has the package on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docquarry-code-"), "docquarry.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
