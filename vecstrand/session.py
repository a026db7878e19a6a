"""Session settings used by tests, the benchmark and stand-alone scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from vecstrand.plans.ship import ship


def session(cpus: int | str = "*", shuffle: int = 8, app: str = "vecstrand", memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the caller brings its own and nothing here is needed.

    UTC everywhere (stamps are naive UTC), adaptive execution with skew splitting, Arrow for every Python boundary and the RocksDB state
    store, so that streaming state is not bounded by the heap.
    """
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark
