"""Session defaults for series work."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use _ for dots."""
    builder = SparkSession.builder.appName("barloom")
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    A temporary one where it is unset, but on one machine only: on a cluster
    executors would not find each other's files there.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; ``spark-submit --py-files`` does the same from outside."""
    sc = spark.sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.md5(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"barloom-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._barloom_shipped = True
