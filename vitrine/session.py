"""Session helpers.

Library operators never build their own session: they take ``spark`` or a
DataFrame. These helpers are for tests, ``bench.py`` and job entry points.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app_name: str = "vitrine", cores: int | str = "*",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on and the UI off (tests and benchmarks)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` (or a folder already given to
    ``setCheckpointDir``) points at shared storage and is used as is. Only a
    local master (tests, bench) without one gets a scratch folder; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder on shared storage")
        current = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    if spark.conf.get(CHECKPOINT_CONF, None) != current:
        spark.conf.set(CHECKPOINT_CONF, current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (for written tables and
    streaming checkpoints)."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
