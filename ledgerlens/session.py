"""Session construction and the shared scratch location.

Every job in the package runs on whatever ``SparkSession`` the caller hands
in. ``build_session`` is only a convenience for tests, the bench and local
runs: it pins the settings the operators assume (UTC session time zone, ANSI
mode, AQE with partition coalescing and skew-join splitting).

``shared_dir`` is the one place that decides where intermediate files go: the
checkpoint folder, a shared filesystem that every executor can reach. Only a
local master gets a temporary folder when the session has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Return a directory on the cluster's shared checkpoint filesystem.

    ``spark.checkpoint.dir`` if it is set, else what ``setCheckpointDir`` was given. With neither, a temporary directory is made and registered if the master is local
    (tests, one machine); on a cluster that is an error, as executors would write to their own disks.
    """
    registered = spark.sparkContext._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if registered.isDefined() and not configured:
        base = registered.get()
    elif configured:
        base = configured
        if not registered.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    else:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts])


def unique_dir(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused directory under :func:`shared_dir`."""
    return shared_dir(spark, "ledgerlens", f"{label}-{uuid.uuid4().hex[:12]}")
