"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build(app: str = "bytesieve", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        require_local(spark.sparkContext.master)
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.sparkContext.setCheckpointDir(base)
    return base


def require_local(master: str) -> None:
    """A folder of this machine is of no use to the executors of a cluster."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_bytesieve_shipped", False):
        return
    base = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "bytesieve.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(base):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(base)))
    context.addPyFile(out)
    context._bytesieve_shipped = True


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
