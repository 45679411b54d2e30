"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local
    mode: on a cluster a machine-local folder would be lost with its machine,
    so an error is raised there instead.
    """
    sc = spark.sparkContext
    if (at := sc.getCheckpointDir()) is not None:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="panelforge-checkpoint-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
