"""Sessions, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import sys
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that it need
    not be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lectern-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lectern_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.join("lectern", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(target)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where spark.checkpoint.dir is unset, as in tests on one machine, a
    temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        inner = sc._jsc.sc().getCheckpointDir()
        found = inner.get() if inner.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted by clean."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _settled.append(path)
    return path


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: a lineage cut that
    outlives executors and is read by column."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def uncollected() -> Iterator[None]:
    """No cyclic garbage collection while a task builds many objects that have
    no cycles: they are freed by their counts, and the search for cycles costs."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_settled: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete what steps have left in the shared folder, once their results are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _settled:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def progress(spark: SparkSession, label: str, every: float = 10.0) -> Iterator[None]:
    """While the body runs, a line now and then with the tasks done of those in its running stages."""
    done, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def tell() -> None:
        while not done.wait(every):
            stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            if stages:
                print(f"{label}: {sum(x.numCompletedTasks for x in stages)} of {sum(x.numTasks for x in stages)} tasks done", file=sys.stderr, flush=True)

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        yield
    finally:
        done.set()
        teller.join()
