"""A folder for what a query has to write: stores, indexes, recordings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from chainfold.sources.store import remove

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it is removed at exit.

    Where that is unset, a local master gets a temporary folder and a cluster is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="chainfold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"{own}/{label}"
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def clean_up() -> None:
    while _made:
        remove(*_made.pop())
