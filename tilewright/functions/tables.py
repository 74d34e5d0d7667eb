"""Small tables from driver values, without any Python on the executors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """``rows`` as a constant of the plan; ``schema`` is ``name:type, ...``. Meant for bounded lists."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
