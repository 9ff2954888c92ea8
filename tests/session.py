from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("civicloom-tests")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", ""):
        # Local tests only: a cluster names its shared folder itself.
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="civicloom-"))
    return spark
