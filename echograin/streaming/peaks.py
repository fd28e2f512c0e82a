"""Row-wise operators on streams: the same functions run on a file stream of waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin import schemas
from echograin.operators import peaks as P
from echograin.operators import points as G


def waveforms(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the waveform files that arrive in a folder."""
    return spark.readStream.schema(schemas.WAVEFORMS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def peaks(stream: DataFrame, share: float = 0.1, width: float | None = 3) -> DataFrame:
    """The relative peaks of a stream of waveforms."""
    return P.relative_peaks(stream, share, width)


def confusion(stream: DataFrame, truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Running counts of true and predicted labels at the peaks of a stream; labels are tables. State is one number per pair of labels."""
    rows = G.labelled(G.labelled(peaks(stream), truth, "ann"), guess, "pred")
    return rows.groupBy("ann", "pred").agg(F.count(F.lit(1)).alias("n"))
