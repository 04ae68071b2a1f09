"""Objects for tasks: broadcast with their classes, so executors need no copy of this package."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shared(spark: SparkSession, value):
    """A broadcast for ``opened``; the caller has checked the size of ``value``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast):
    return cloudpickle.loads(broadcast.value)
