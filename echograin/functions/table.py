"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql import functions as F

from echograin.operators import peaks as P

#: The function's options, all of them optional.
OPTIONS = ("height", "share", "distance", "prominence", "width")


class FindPeaks:
    """find_peaks(TABLE(t) [PARTITION BY ...], height => 5, share => 0.1, distance => 5, prominence => 4, width => 1).

    The table has one array column of counts, hist, and any other columns, which are carried: a row for each peak with them, bin, height,
    prominence and width. height is a number of counts and share a part of the waveform's largest; a peak reaches
    both. Rows are gathered and handed to the kernel of peaks.find_peaks() many at once. A null or empty waveform has no peaks.
    """

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.options: dict[str, float | None] = {}

    @staticmethod
    def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(table.dataType, StructType) or "hist" not in table.dataType.names:
            raise ValueError("find_peaks needs a table with a column hist")
        if not isinstance(table.dataType["hist"].dataType, ArrayType):
            raise ValueError("hist is no array")
        if unknown := [n for n in options if n not in OPTIONS]:
            raise ValueError(f"find_peaks has no option {unknown[0]}")
        found = [StructField(n, t) for n, t in (("bin", IntegerType()), ("height", DoubleType()), ("prominence", DoubleType()), ("width", DoubleType()))]
        taken = {f.name for f in found}
        carried = [f for f in table.dataType.fields if f.name != "hist"]
        if clash := [f.name for f in carried if f.name.lower() in taken]:
            raise ValueError(f"the table has a column {clash[0]} already")
        return AnalyzeResult(StructType([*carried, *found]))

    def eval(self, row: Row, **options: float | None) -> Iterator[tuple]:
        self.options = {n: None if v is None else float(v) for n, v in options.items()}
        self.rows.append(row)
        if len(self.rows) >= P.BATCH:
            yield from self._found()

    def terminate(self) -> Iterator[tuple]:
        yield from self._found()

    def _found(self) -> Iterator[tuple]:
        rows, self.rows = self.rows, []
        hists = pa.array([r["hist"] for r in rows], pa.list_(pa.float64()))
        share = self.options.get("share")
        low = np.array([max(self.options.get("height") or -np.inf, (max(h) if share and h else -np.inf) * (share or 1)) for h in hists.to_pylist()]) if share else np.full(len(rows), self.options.get("height") or -np.inf)
        names = ("distance", "prominence", "width")
        for k, *peak in P.peaks_of(hists, low, **{n: self.options.get(n) for n in names}):
            yield (*[v for n, v in rows[k].asDict(False).items() if n != "hist"], *peak)


def register(spark: SparkSession) -> UserDefinedTableFunction:
    """Makes find_peaks known to the session's SQL."""
    return spark.udtf.register("find_peaks", F.udtf(FindPeaks))
