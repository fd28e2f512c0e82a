"""Failures as rows: what a kernel raises on a waveform or a window stops nothing, and each frame has a status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded(kernel: Callable[[pa.RecordBatch], pa.RecordBatch], keys: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A kernel whose results have a last column `error`. A slice on which it raises is halved until single rows are left: each of those that fail is a row of its keys (the first columns) and the error."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            out = kernel(batch)
        except Exception as e:  # any failure becomes a row
            if batch.num_rows > 1:
                half = batch.num_rows // 2
                yield from run(batch.slice(0, half))
                yield from run(batch.slice(half))
                return
            empty = kernel(batch.slice(0, 0))
            arrays = [batch.column(k) if k < keys else pa.nulls(1, empty.column(k).type) for k in range(empty.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([f"{type(e).__name__}: {e}"[:200]])], names=[*empty.schema.names, "error"])
            return
        yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.string())], names=[*out.schema.names, "error"])

    return run


def status(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, status (ok or failed) and error of each of frames (frame_id, one row each); rows have an error, null where all is well. Frames without rows are ok."""
    failed = rows.where("error IS NOT NULL").groupBy("frame_id").agg(F.min("error").alias("error"))
    return frames.select("frame_id").join(failed, "frame_id", "left").select("frame_id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def split(rows: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the frames without a failure, and status() of each frame. rows is read twice and should be a written table."""
    failed = rows.where("error IS NOT NULL").select("frame_id").distinct()
    return rows.join(failed, "frame_id", "left_anti"), status(rows, frames)
