"""The session that the engine's queries expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC is a neutral axis for naive wall-clock times; ANSI makes lossy casts and x/0 fail instead of inventing a value.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, take the session as given."""
    cpus = cpus or os.cpu_count() or 2
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | more
    return SparkSession.builder.master(f"local[{cpus}]").appName("hourloom").config(map=conf).getOrCreate()
