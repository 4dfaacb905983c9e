"""Reading feature matrices and golden cases."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, clip_idx, vector) of the matrices ``<video_id>.npy`` under ``path``; a video without a file has no rows.

    A matrix is read whole by one task; the files are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if x.ndim == 2 and x.size:
                    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                    vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float64).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), vectors], names=["video_id", "clip_idx", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("video_id"), "content")
    return rows.mapInArrow(run, "video_id string, clip_idx long, vector array<double>")


def golden_cases(spark: SparkSession, path: str, tool: str | None = None) -> DataFrame:
    """(file, id, question, expected_tool, expected_args) of all cases under ``path``: YAML where its library is installed, else JSON; those of one tool if it is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from yaml import safe_load as load
        except ImportError:
            load = json.loads
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = load(text) or []
                for case in found.get("cases", []) if isinstance(found, dict) else found:
                    rows.append((name.rpartition("/")[2], *(None if case.get(k) is None else str(case[k]) for k in ("id", "question", "expected_tool")), json.dumps(case.get("expected_args") or {}, sort_keys=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["file", "id", "question", "expected_tool", "expected_args"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    cases = texts.mapInArrow(run, "file string, id string, question string, expected_tool string, expected_args string")
    return cases if tool is None else cases.where(F.col("expected_tool") == tool)
