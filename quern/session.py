"""What a session needs so that its Python workers can import this package, and where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import this package, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (paths := env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def own_folder() -> str:
    """A temporary folder that goes with this process: for local masters, where driver and executors are one."""
    folder = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's spark.checkpoint.dir; where that is unset and the master local, in a temporary
    folder. A cluster without a shared folder is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or own_folder())
    return df.checkpoint()
