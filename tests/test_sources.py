"""Tick files in and bars out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.api import Ticks
from barloom.operators.bars import BarFeature
from barloom.sources import ticks as S


@pytest.fixture
def files(tmp_path):
    out = []
    for k in range(2):
        p = tmp_path / f"part{k}.csv"
        p.write_text("date_time,price,volume\n" + "".join(f"2020-01-0{k + 1} 00:00:{i:02d},{10 + i + k},{2}\n" for i in range(20)) + ("broken,row\n" if k else ""))
        out.append(str(p))
    return out


def test_csv_keeps_the_order_of_files_and_rows(spark, files):
    rows = S.read_tick_csv(spark, files[::-1])
    good = rows.where("_malformed is null").orderBy("seq").collect()
    assert [r.price for r in good] == [float(11 + i) for i in range(20)] + [float(10 + i) for i in range(20)]
    assert len([r for r in rows.collect() if r["_malformed"]]) == 1


def test_ticks_object(spark, files, tmp_path):
    t = Ticks.from_csv(spark, files)
    bars = t.volume_bars(10, path=str(tmp_path / "bars"), kind="parquet")
    assert bars.count() == 8 and "_series" not in bars.columns
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 8
    assert t.tick_bars(10).count() == 4 and t.dollar_bars(100).count() > 0 and t.time_bars("H").count() == 1
    assert t.bars_with_features(bars, [BarFeature("n", F.count("price"))]).where("n = 5").count() == 8
    assert t.imbalance_bars("tick").count() == 0 and t.run_bars("dollar", thresholds=True).columns[-1] == "cum_theta"
    with pytest.raises(ValueError):
        t.time_bars("W")
    with pytest.raises(ValueError):
        Ticks(t.df.drop("seq"))


def test_contract(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, "x")], "ts timestamp, price double, volume string")
    with pytest.raises(ValueError, match="volume is string"):
        S.check_ticks(df)
    with pytest.raises(ValueError, match="price is missing"):
        S.check_ticks(df.drop("price"))


def test_raw_text_and_panels(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("ticker,per,date,time,price,volume\nA,0,20200102,93005,1.5,10\nA,0,bad,1,1.5,10\n")
    rows = S.read_raw_tick_text(spark, str(p)).collect()
    assert [r.ts for r in rows] == [dt.datetime(2020, 1, 2, 9, 30, 5), None]
    S.csv_to_parquet(spark, str(p), str(tmp_path / "out"), spark.read.option("header", True).csv(str(p)).schema)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    one = spark.createDataFrame([(1, "s", 5.0)], "ts long, security string, value double")
    out = S.join_panels({"open": one, "close": one.withColumn("value", F.lit(6.0))}).first()
    assert (out.open, out.close) == (5.0, 6.0)


def test_panels_of_more_securities_than_a_plan_has_columns(spark, tmp_path):
    """A pivot ends at 10,000 columns and Spark's CSV reader at 20,480."""
    n = 21_000
    rows = spark.range(n).selectExpr("explode(sequence(1L, 2L)) as ts", "id * 3 as instrument").selectExpr("*", "ts + instrument / 7D as o", "if(instrument % 2 = 0, ts - 0.5D, null) as c").where(f"not (ts = 2 and instrument >= {3 * n - 6})")
    for x in "oc":
        S.write_panel(rows, str(tmp_path / x), "ts", "instrument", x)
    out = S.read_panels(spark, {x: str(tmp_path / x) for x in "oc"})
    assert out.count() == 2 * n
    found = out.where("o is not null").selectExpr("cast(ts as bigint) as ts", "cast(security as bigint) as instrument", "o", "c")
    assert found.count() == 2 * n - 2 and found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()


def test_panels_are_read_by_each_files_header(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "1.csv").write_text('ts,x,"y,""z""",w\n1,1.5,2,3\n\n2,,4\n')
    (a / "2.csv").write_text('w,ts,x\n"7",3,8\n')
    (b / "1.csv").write_text('"y,\\"z\\"",ts,x\n10,1,20\n30,2,40\n50,3,60\n70,4,80\n')
    got = {tuple(r) for r in S.read_panels(spark, {"a": str(a), "b": str(b)}).collect()}
    assert got == {("1", "x", 1.5, 20.0), ("1", 'y,"z"', 2.0, 10.0), ("2", "x", None, 40.0), ("2", 'y,"z"', 4.0, 30.0), ("3", "x", 8.0, 60.0)}
    with pytest.raises(ValueError, match="day is missing"):
        S.read_panels(spark, {"a": str(a)}, "day")


def test_a_written_panel_is_plain_csv(spark, tmp_path):
    names = ["a,b", 'q"u', "back\\slash", " blank", "plain"]
    rows = spark.createDataFrame([(t, s, t + i / 4) for t in (1, 2) for i, s in enumerate(names) if (t, i) not in ((1, 0), (2, 4), (1, 2))] + [(1, None, 9.0)], "t long, s string, v double")
    S.write_panel(rows.unionAll(rows), str(tmp_path / "p"), "t", "s", "v")
    wide = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert set(wide.columns) == {"t", *names}
    want = {(str(r.t), r.s): r.v for r in rows.where("s is not null").collect()}
    assert {(r["t"], s): float(r[s]) for r in wide.collect() for s in names if r[s] is not None} == want
    assert {(r.t, r.security): r.v for r in S.read_panels(spark, {"v": str(tmp_path / "p")}, "t").where("v is not null").collect()} == want
    S.write_panel(rows.where("false"), str(tmp_path / "none"), "t", "s", "v")
    assert S.read_panels(spark, {"v": str(tmp_path / "none")}, "t").count() == 0
