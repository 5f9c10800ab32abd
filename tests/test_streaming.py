"""Streaming equals batch, whatever the cut into micro-batches."""

import pytest

from barloom.operators import bars as B
from barloom.plans.bars import WARM
from barloom.plans.inputs import ticks
from barloom.streaming import bars as T


@pytest.mark.parametrize("kind", ["volume", "run"])
def test_streamed_bars_equal_batch(spark, folder, tmp_path, kind):
    df = ticks(spark, folder).where("instrument % 3 = 0")
    if kind == "volume":
        batch = B.volume_bars(df, threshold=250)
        build = lambda s: T.stream_threshold_bars(s, ["instrument"], "volume", 250)
    else:
        batch = B.run_bars(df, "tick", expectation=WARM)
        build = lambda s: T.stream_run_bars(s, ["instrument"], "tick", WARM)
    out = T.replay(df, build, f"file://{tmp_path}", kind, parts=2)
    key = lambda d: sorted((r.instrument, r.tick_num, r.open, r.close, r.volume) for r in d.collect())
    assert key(out) == key(batch)
    assert {r.late for r in out.collect()} <= {0}


def test_late_rows_go_by_time_and_then_sequence(spark, tmp_path):
    schema = "instrument long, ts timestamp, seq long, price double, volume double"
    at = lambda s: f"2020-01-01 00:00:{s:02d}"
    batches = [[(1, at(9), 1, 1.0, 5.0), (1, at(10), 5, 2.0, 5.0)], [(1, at(10), 3, 9.0, 5.0), (1, at(10), 6, 3.0, 5.0), (1, at(8), 9, 9.0, 5.0), (2, at(1), 1, 4.0, 5.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "instrument long, ts string, seq long, price double, volume double").selectExpr("instrument", "cast(ts as timestamp) ts", "seq", "price", "volume").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.stream_threshold_bars(stream, ["instrument"], "volume", 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = sorted((r.instrument, r.close, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(1, 1.0, 0), (1, 2.0, 0), (1, 3.0, 2), (2, 4.0, 0)]
