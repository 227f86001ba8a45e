"""A session with the settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(name: str = "logloom", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set and all runs on one machine, a temporary one."""
    context = spark.sparkContext
    set_one = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_one.get() if set_one.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/logloom-checkpoints"
    if not set_one.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")
