"""A local session with the settings the engine is tested with; on a cluster use its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "32m",
    }
    return SparkSession.builder.master(f"local[{n}]").appName("forkscope").config(map=settings).getOrCreate()
