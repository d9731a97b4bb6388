"""Session access, table reading and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


class EngineError(Exception):
    """Base of the engine's errors."""


class IoError(EngineError):
    pass


class ParseError(EngineError):
    pass


class InvalidInput(EngineError):
    pass


class Unsupported(EngineError):
    pass


class EvalError(EngineError):
    pass


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage.

    The folder is the one of ``spark.checkpoint.dir``; only where that is unset and the master is local
    (tests on one machine) a local one is made. A cluster without a shared folder is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise InvalidInput("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgrid-checkpoint-"))
    return df.checkpoint(eager=True)
