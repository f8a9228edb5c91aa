"""Structured Streaming twins of the write path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def keyed_state(spark: SparkSession) -> None:
    """Keeps the state of streams that start from now on in RocksDB, which holds maps and timers by key and more state than memory; its changes go to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
