"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def build_session(app_name: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Sizes (executor memory, shuffle partitions) belong to the cluster and are
    left alone unless passed in ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(LAST_KEY_WINS, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session that was built elsewhere: the package in its workers, and JSON
    objects that repeat a key read as their last value instead of as invalid."""
    spark.conf.set(LAST_KEY_WINS, "true")
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application.

    Not needed where it is installed on the executors or given by ``--py-files``.
    """
    sc = spark.sparkContext
    if _shipped.get("to") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="lexmill-"), "lexmill")
    sc.addPyFile(shutil.make_archive(archive, "zip", root, "lexmill"))
    _shipped["to"] = sc.applicationId


_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of this machine is made up only for a local master, where the
    driver and the executors are one process.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="lexmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def shuffle_width(spark: SparkSession) -> int:
    """Number of tasks a shuffle is planned for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
