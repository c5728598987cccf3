"""Sessions and tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "granary", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and ANSI arithmetic; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, for values that depend on how rows were partitioned.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; a temporary one of this
    machine is taken only where none is set, under a local master.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share when the master is {context.master}")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-"))
    return df.checkpoint(eager=True)
