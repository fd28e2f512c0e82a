"""Tables bucketed by voxel: label joins on them take place where the rows are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

VOXEL = ("frame_id", "x", "y", "bin")


def write_bucketed(rows: DataFrame, path: str, buckets: int, keys: tuple[str, ...] = VOXEL, name: str = "") -> DataFrame:
    """rows as a Parquet table at `path`, in `buckets` parts by a hash of the keys and sorted by them; returns the table.

    Tables of the same keys, key types and number of buckets are joined on all the keys without a shuffle: points.labelled() of
    peaks with labels and predictions. Each bucket is one file, so that its order is known. The table is external, in the
    session's catalogue under `name` or a new name, and replaces what the path held. It carries a hint to merge: sorted files are
    so small for their rows that Spark would take a large table for one to broadcast, through the driver.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    placed = rows.repartition(buckets, *keys)
    placed.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name).hint("merge")
