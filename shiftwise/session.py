"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once per application: they need not be started where it lies.

    Spark copies the archive to every executor, also to those that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shiftwise-")
    try:
        kept = shutil.ignore_patterns("__pycache__")
        shutil.copytree(package, f"{folder}/zip/{package.name}", ignore=kept)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/zip"))
    finally:
        shutil.rmtree(f"{folder}/zip", ignore_errors=True)
    _sent.add(context.applicationId)


def local_session(cpus: int | str = 8, name: str = "shiftwise") -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own and calls ``send_package``."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHIFTWISE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    send_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shiftwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/shiftwise/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint, so iterative operators survive a lost executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
