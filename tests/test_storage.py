import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.functions import scalars as C
from tidebars.operators import quality as Q
from tidebars.schema import BARS, validate_schema
from tidebars.sources import bars as B
from tidebars.sources import params as P
from tidebars.sources import storage as ST
from tidebars.streaming import live as L


@pytest.fixture
def bars(spark):
    def make(closes, ticker="AAPL", timeframe="1d", start="2026-06-01", step="day"):
        rows = [(ticker, timeframe, i, None if c is None or c != c else float(c)) for i, c in enumerate(closes)]
        df = spark.createDataFrame(rows, "ticker string, timeframe string, i int, close double")
        return df.select("ticker", "timeframe", F.expr(f"timestampadd({step}, i, timestamp_ntz'{start}')").alias("ts"),
                         (F.col("close") - 0.1).alias("open"), (F.col("close") + 0.3).alias("high"), (F.col("close") - 0.3).alias("low"),
                         "close", F.lit(1000.0).alias("volume"))
    return make


def walk(n, seed=42):
    return 100 + np.cumsum(0.5 * np.random.RandomState(seed).randn(n))


def closes(df):
    return [r.close for r in df.orderBy("ts").collect()]


def test_latest_rows(bars):
    df = bars(walk(50)).unionByName(bars(walk(60, 1), timeframe="60m", step="hour"))
    daily = lambda d: d.where("timeframe = '1d'")
    assert daily(B.latest_n(df, 5)).count() == 5 and daily(B.latest_n(df, 999)).count() == 50
    assert daily(B.latest_n(df, 30, day_offset=10)).count() == 30
    assert daily(B.before_offset(df, 10)).count() == 40 and daily(B.before_offset(df, 10, exclusive=True)).count() == 39
    assert B.for_series(df, "AAPL", "60m").count() == 60


def test_upsert_rules(bars):
    base = bars([1, 2, 3, 4, 5])
    again = Q.merge_bars(base, bars([9, 9, 9, 9, 99.5]))
    assert closes(again) == [1, 2, 3, 4, 99.5]
    assert closes(Q.merge_bars(base.where("false"), bars([7, 8]))) == [7, 8]
    late = bars([7], start="2026-06-03").unionByName(bars([8, 9], start="2026-06-05"))
    assert closes(Q.merge_bars(base.where("close <> 3"), late)) == [1, 2, 7, 4, 8, 9]
    assert closes(Q.force_merge(base, bars([200.5] * 3))) == [200.5] * 3 + [4, 5]


def test_compare_two_sources(bars):
    base = bars(walk(10))
    same = Q.compare_bars(base, base).first()
    assert same.status == "ok" and same.diffs == 0 and same.overlap == 10
    new = Q.compare_bars(base, bars([1] * 5, start="2026-06-11")).first()
    assert new.status == "update_available" and new.overlap == 0 and new.only_other == 5 and new.fingerprint_match
    bad = Q.compare_bars(base, bars([99.5] * 10)).first()
    assert bad.status == "conflict" and bad.diffs > 0
    empty = Q.compare_bars(base.where("false"), bars([1] * 5)).first()
    assert empty.base_count == 0 and empty.only_other == 5 and empty.base_start == "-"
    hole = Q.compare_bars(bars([1, None]), bars([1, 2])).first()
    assert hole.diffs == 1 and hole.status == "conflict"


def test_fingerprint_is_the_digest_of_the_lines(bars):
    import hashlib

    df = bars([1.25, 2.5]).unionByName(bars([3.0], ticker="MSFT"))
    got = {r.ticker: r.fingerprint for r in Q.fingerprint(df).collect()}
    assert got["AAPL"] == hashlib.md5(b"2026-06-01T00:00:00:1.25002026-06-02T00:00:00:2.5000").hexdigest()
    assert got["MSFT"] == hashlib.md5(b"2026-06-01T00:00:00:3.0000").hexdigest()


def test_health(bars):
    df = bars([1, 2]).unionByName(bars([3], start="2026-06-10"))
    h = Q.data_health(df, "2026-06-12").first()
    assert h.gaps == 1 and h.status == "gaps" and h.warnings == 1
    stale = Q.data_health(df, "2026-07-12").first()
    assert stale.status == "stale" and stale.warnings == 2
    assert Q.data_health(bars([1, None, 2]), "2026-06-04").first().status == "null_values"
    assert Q.health_summary(Q.data_health(df.where("false"), "2026-06-04")).first().status == "error"
    weekly = bars([1, 2], timeframe="1wk").unionByName(bars([1], timeframe="1wk", start="2027-01-01"))
    assert Q.data_health(weekly, "2026-06-04").first().gaps == 0
    over_month = bars([1], start="2026-06-29").unionByName(bars([1], start="2026-07-09"))
    assert Q.gap_count(over_month).first().gaps == 1


def test_backfill(bars):
    df = bars([1, 2, None]).unionByName(bars([8, 9], timeframe="1wk"))
    assert closes(Q.backfill_close(df).where("timeframe = '1d'")) == [1, 2, 9]


def test_windows_and_versions(spark, bars, tmp_path):
    df = bars(walk(10)).unionByName(bars([1, 2, 3], ticker="X"))
    B.write_window(df, str(tmp_path / "w"))
    back = B.read_window(spark, str(tmp_path / "w"))
    assert back.count() == 10 and dict(back.dtypes)["timeframe"] == "string"
    df.select("ticker", "timeframe", "ts", "close").write.parquet(str(tmp_path / "bare"))
    assert B.read_window(spark, str(tmp_path / "bare")).where("open = close").count() == 10
    root = str(tmp_path / "v")
    for v in ("1", "2", "3"):
        ST.snapshot(df.limit(int(v)), root, v)
    assert [r.version for r in ST.list_versions(spark, root).orderBy("rank").collect()] == ["3", "2", "1"]
    assert ST.restore(spark, root, "2").count() == 2
    assert ST.prune(spark, root, keep=2) == ["1"]
    ST.write_ranking(spark.createDataFrame([(1, 0.12345678)], "rank int, mse double"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().mse == "0.123457"


def test_materialized_tables(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = ST.materialize(df)
    assert back.dtypes == df.dtypes and back.count() == 10 and len(back.inputFiles()) > 0


def test_schema_check(spark, bars):
    df = bars([1, 2])
    assert validate_schema(df.withColumn("more", F.lit(1)), BARS).columns == BARS.fieldNames()
    with pytest.raises(ValueError, match="volume"):
        validate_schema(df.drop("volume"), BARS)
    with pytest.raises(ValueError, match="close"):
        validate_schema(df.withColumn("close", F.lit("x")), BARS)


def test_ticks_of_equal_time_and_big_ids(spark):
    t = spark.createDataFrame([(5, "2024-01-01 00:00:01", 1.0), (-9223372036854775808, "2024-01-01 00:00:01", 2.0),
                               (9223372036854775807, "2024-01-01 00:00:01", 3.0), (1, "2024-01-01 00:00:00.999999", 4.0)], "id long, ts string, p double")
    t = t.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("ticker", F.lit("a"))
    late = t.where("p < 4")
    r = B.ohlcv(late, "1m", price="p", volume="p", tie="id").first()
    assert (r.open, r.close, r.high, r.low, r.volume) == (2.0, 3.0, 3.0, 1.0, 6.0)
    assert B.ohlcv(t, "1m", price="p", volume="p", tie="id").first().open == 4.0


def test_symbols_and_text(spark):
    df = spark.createDataFrame([("CN", "600000"), ("CN", "000001"), ("HK", "700"), ("HK", "09988"), ("US", "aapl")], "m string, c string")
    got = [r[0] for r in df.select(C.normalize_symbol(F.col("m"), F.col("c"))).collect()]
    assert got == ["600000.SS", "000001.SZ", "0700.HK", "09988.HK", "AAPL"]
    with pytest.raises(Exception, match="empty ticker code"):
        spark.createDataFrame([("US", "  ")], "m string, c string").select(C.normalize_symbol(F.col("m"), F.col("c"))).collect()
    w = spark.createDataFrame([("2024-01-01T09:30:00+08:00",), ("2024-01-01T09:30:00",)], "t string").select(C.text_wall_clock(F.col("t")).alias("t"))
    assert len({r.t for r in w.collect()}) == 1


def test_parameter_files(spark, tmp_path):
    good = {"market": "HK", "ticker": "2382", "global_f": "savgol", "global_f2": "sma", "v0_tf": "日线", "v0_n": 200, "v0_ke": 0.2, "v0_sch": False,
            "v1_fm": "poly2", "v1_n": "many", "窗口大小_v0_f1_savgol": 8, "多项式阶数_v0_f1_savgol": 11, "窗口大小_v0_f2_sma": 500}
    (tmp_path / "2382_HK_DP.json").write_text(json.dumps(good, ensure_ascii=False))
    (tmp_path / "old_QS.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "list.json").write_text("[1]")
    sets, errors = P.load_param_sets(spark, str(tmp_path))
    by = {r.name: r for r in sets.collect()}
    assert set(by) == {"2382_HK_DP", "old_QS"} and by["2382_HK_DP"].category == "dual" and by["2382_HK_DP"].description == "HK·2382"
    assert {r.name for r in errors.collect()} == {"bad", "list"}
    have = spark.createDataFrame([("old_QS",)], "name string")
    assert P.load_param_sets(spark, str(tmp_path), have)[0].count() == 1
    assert P.load_param_sets(spark, str(tmp_path), have, force=True)[0].count() == 2
    views = {r.view: r for r in P.param_views(spark, str(tmp_path)).collect()}
    v0, v1 = views[0], views[1]
    assert (v0.timeframe, v0.n, v0.k_eps, v0.show_signal, v0.ewma_span) == ("1d", 200, 0.2, False, 60)
    assert v0.filter_params == {"window": 9.0, "order": 5.0} and v0.filter2_params["window"] == 101.0
    assert v1.fit_mode == "poly2" and v1.n == 120 and v1.filter_params == {"window": 21.0, "order": 2.0}


def test_cross_params_takes_any_number_of_sets(spark):
    sets = spark.range(12_345).withColumnRenamed("id", "param_id")
    done = P.cross_params(spark.range(7), sets)
    assert done.count() == done.distinct().count() == 7 * 12_345


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from unittest.mock import MagicMock

    cluster = MagicMock()
    cluster.conf.get.return_value = None
    cluster.sparkContext.master = "spark://host:7077"
    named = cluster.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value
    named.isDefined.return_value = False
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ST.scratch_root(cluster)
    named.isDefined.return_value, named.get.return_value = True, "hdfs://shared/x/"
    assert ST.scratch_root(cluster) == "hdfs://shared/x"


def test_open_and_closed_bars_in_the_sink(spark, bars, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: closes(B.read_partitioned(spark, f"{path}/bars"))
    L.upsert_partitions(bars([1, 2, 3], start="2026-06-29"), path)
    assert read() == [1, 2, 3]
    L.upsert_partitions(bars([9, 9, 30, 40], start="2026-06-29"), path)
    assert read() == [1, 2, 30, 40]
    L.upsert_partitions(bars([5], start="2026-05-01"), path)
    L.upsert_partitions(bars([5], start="2026-05-01"), path)
    assert read() == [5, 1, 2, 30, 40]


def test_first_prediction_stays(spark, tmp_path):
    path = str(tmp_path / "f")
    make = lambda rows: spark.createDataFrame(rows, "ticker string, timeframe string, idx long, prediction double, arrival long")
    L.freeze_partitions(make([("a", "1d", 1, 1.0, 1), ("a", "1d", 1, 2.0, 2)]), path)
    L.freeze_partitions(make([("a", "1d", 1, 3.0, 3), ("a", "1d", 2, 4.0, 3)]), path)
    assert {(r.idx, r.prediction) for r in spark.read.parquet(path).collect()} == {(1, 1.0), (2, 4.0)}


def test_live_state_matches_kalman_filter(series, values):
    from tidebars.operators.filters import apply_filter

    x = walk(60)
    s, got = L.SignalState(), []
    for v in x:
        got.append(s.push(v, 9 / 11, 2 / 61, 0.15, 0.05, 0.01, 1.0))
        s = L.SignalState(s.values())
    df = series({"a": x})
    assert np.allclose([g[1] for g in got], values(apply_filter(df, "kalman", {"Q": 0.01, "R": 1.0})))
    assert np.allclose([g[0] for g in got], values(apply_filter(df, "ema", {"span": 10})))
