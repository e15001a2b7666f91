"""Trajectories as streams: frames that a running simulation appends are measured as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def frames(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the rows of frames under ``path`` (as ``append_frame`` writes them)."""
    return spark.readStream.schema(schema).parquet(path)


def kinetic_by_step(stream: DataFrame) -> DataFrame:
    """(step, particles, kinetic) in complete mode: sums by step, pre-aggregated in each task."""
    energy = F.expr("0.5D * mass * (vx * vx + vy * vy + vz * vz)")
    return stream.groupBy("step").agg(F.count("*").alias("particles"), F.sum(energy).alias("kinetic"))
