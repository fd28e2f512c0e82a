"""A stream of waveform files gives what the table gives."""

from pyspark.sql import functions as F

from echograin import fixtures
from echograin.operators import peaks as P
from echograin.operators import points as G
from echograin.streaming import peaks as S

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    rows = fixtures.waveforms(spark, SF).select(F.col("frame_id"), "x", "y", "hist")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    truth, guess = fixtures.labels(spark, SF), fixtures.labels(spark, SF, "pred")
    stream = S.confusion(S.waveforms(spark, str(tmp_path / "in"), 2), truth, guess)
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    table = G.labelled(G.labelled(P.relative_peaks(rows), truth, "ann"), guess, "pred").groupBy("ann", "pred").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, table.collect()))
