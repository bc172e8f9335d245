"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

PINNED = {
    "spark.sql.ansi.enabled": "true",  # integer overflow raises
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.ansi.doubleQuotedIdentifiers": "false",
    "spark.sql.adaptive.enabled": "true",
}


def build(app: str = "tabq", cores: str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return pin(builder.config(map=PINNED | conf).getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    for k, v in PINNED.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir has set.

    On a local master without either a folder is made, and removed when the process ends; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if there := sc.getConf().get("spark.checkpoint.dir"):
        return there
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tabq-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with reliable files in the shared folder; Spark removes them with the frame where it is told to clean checkpoints."""
    sc, there = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return df.checkpoint(eager=True)
