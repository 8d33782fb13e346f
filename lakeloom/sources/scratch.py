"""A folder for intermediate tables that all executors reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from lakeloom.errors import QueryError


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder only where that is unset and the master is local (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise QueryError("QUERY_FAILED", "spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/lakeloom-{uuid.uuid4().hex}"
