"""Session helpers shared by the entry points, the tests and the bench."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, name: str = "lexweave", **conf: str) -> SparkSession:
    """A session for one machine. On a cluster use the cluster's own session instead."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEXWEAVE_DRIVER_MEMORY", "8g"),
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver was not started with it on PYTHONPATH."""
    env = spark.sparkContext.environment
    known = os.pathsep.join((env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables in a data folder; any path that Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
