"""Kinds of results that come one by one: where one fails, its fallback or nothing comes, and the others stay."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import durable

LONGEST = 1000  # characters of an error
STATUS = "kind string, state string, n long, error string"


def isolated(spark: SparkSession, ways: dict[str, Callable[[], DataFrame]], schema: str, fallbacks: dict[str, Callable[[], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of every kind (``schema``, and kind), and one row per kind: state (done, fallback or failed), number of rows, and what went wrong.

    Each kind is run to its end and written before the next begins, so that a failure in its data is its own. Columns beyond the schema are left out.
    """
    empty = spark.createDataFrame([], schema)
    parts, status = [], []
    for kind, way in ways.items():
        states, wrong = [("done", way), *([("fallback", fallbacks[kind])] if kind in (fallbacks or {}) else [])], None
        for state, run in states:
            try:
                rows = run()
                rows = durable(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema)).withColumn("kind", F.lit(kind)))
                parts.append(rows)
                status.append((kind, state, rows.count(), wrong))
                break
            except Exception as error:  # a kind's own
                wrong = wrong or f"{type(error).__name__}: {error}"[:LONGEST]
        else:
            status.append((kind, "failed", 0, wrong))
    rows = reduce(DataFrame.unionByName, parts, empty.withColumn("kind", F.lit("")))
    return rows, spark.createDataFrame(status, STATUS)
