import datetime

import pytest

from tidebars.streaming import live as L

BAR = "ticker string, timeframe string, ts timestamp_ntz, close double"


def at(k, days=0):
    return datetime.datetime(2026, 6, 1) + datetime.timedelta(hours=k, days=days)


def drain(stream, tmp_path, name, mode="append", sink=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}"))
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", str(tmp_path / f"out-{name}"))
    q = L.start(writer)
    q.awaitTermination()
    return q


def test_replay_keeps_the_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1d", at(k), float(k)) for k in range(100)][::-1], BAR).repartition(4)
    seen = []
    stream = L.replay(rows, str(tmp_path / "in"), files=5)
    q = drain(stream, tmp_path, "order", sink=lambda batch, i: seen.append(sorted(r["close"] for r in batch.collect())))
    assert L.batch_count(q) == len(seen) == 5
    assert [x for part in seen for x in part] == [float(k) for k in range(100)]


def test_state_lives_over_batches_and_late_bars_are_left_out(spark, tmp_path):
    values = [((k * 37) % 11) / 3 for k in range(80)]
    rows = [("a", "1d", at(k), v, at(k)) for k, v in enumerate(values)] + [("a", "1d", at(5), 99.0, at(60)), ("a", "1d", at(79), 5.0, at(90))]
    stream = L.replay(spark.createDataFrame(rows, f"{BAR}, arrival timestamp_ntz"), str(tmp_path / "in"), "arrival", 5)
    q = drain(L.stream_signal(stream), tmp_path, "signal")
    assert L.batch_count(q) >= 4
    state, want = L.SignalState(), []
    for v in values:
        want.append(state.push(v, 9 / 11, 2 / 61, 0.15, 0.05, 0.01, 1.0))
    got = spark.read.parquet(str(tmp_path / "out-signal")).orderBy("ts").collect()
    assert len(got) == len(want) == 80
    for r, w in zip(got, want):
        assert [r[c] for c in ("filtered", "kalman", "v", "a", "mu", "sigma", "sig", "dur")] == pytest.approx(w, abs=1e-12)


def test_gradient_over_batches(spark, tmp_path):
    values = [((k * 37) % 11) / 3 for k in range(60)]
    rows = [("a", "1d", at(k), v, at(k)) for k, v in enumerate(values)] + [("a", "1d", at(5), 99.0, at(40))]
    # the newest bar comes again with another value before the next one closes it
    rows += [("a", "1d", at(59), 7.0, at(70)), ("a", "1d", at(60), 1.0, at(80)), ("a", "1d", at(61), 2.0, at(81))]
    stream = L.replay(spark.createDataFrame(rows, f"{BAR}, arrival timestamp_ntz"), str(tmp_path / "in"), "arrival", 6)
    q = drain(L.stream_gradient(stream), tmp_path, "gradient")
    assert L.batch_count(q) >= 4
    got = {r["ts"]: (r["v"], r["a"]) for r in spark.read.parquet(str(tmp_path / "out-gradient")).collect()}
    assert set(got) == {at(k) for k in range(2, 62)}
    closed = [*values[:59], 7.0, 1.0, 2.0]
    for k in (3, 10, 41, 60, 61):
        v = closed[k - 1] - closed[k - 2]
        assert got[at(k)] == pytest.approx((v, v - (closed[k - 1] - closed[k - 3]) / 2))


def test_late_bars_fill_holes_over_batches(spark, tmp_path):
    cols = "ticker string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, arrival timestamp_ntz"
    rows = [("a", "60m", at(k), 1.0, 1.0, 1.0, float(k), 1.0, at(k)) for k in range(50) if k != 7]
    rows += [("a", "60m", at(7), 1.0, 1.0, 1.0, 7.0, 1.0, at(45)), ("a", "60m", at(8), 1.0, 1.0, 1.0, -1.0, 1.0, at(45))]
    stream = L.replay(spark.createDataFrame(rows, cols), str(tmp_path / "in"), "arrival", 5).drop("arrival")
    q = drain(stream, tmp_path, "bars", sink=L.bars_sink(str(tmp_path / "t")))
    assert L.batch_count(q) == 5
    assert [r["close"] for r in spark.read.parquet(str(tmp_path / "t" / "bars")).orderBy("ts").collect()] == [float(k) for k in range(50)]


def test_silent_series_are_told(spark, tmp_path):
    rows = spark.createDataFrame([(t, "1d", at(k), 1.0) for t in "ab" for k in range(3)], BAR)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "alerts")
    q = L.start(L.stale_alerts(stream, "1 second").writeStream.outputMode("append").format("parquet").option("path", out)
                .option("checkpointLocation", str(tmp_path / "check")), "200 milliseconds")
    try:
        for _ in range(120):
            q.awaitTermination(0.5)
            told = {(r["ticker"], r["last_ts"]) for r in spark.read.schema("ticker string, timeframe string, last_ts timestamp_ntz").parquet(out).collect()} if (tmp_path / "alerts").exists() else set()
            if len(told) == 2:
                break
    finally:
        q.stop()
    assert told == {("a", at(2)), ("b", at(2))}


def test_frozen_store_reads_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "f")
    make = lambda lo, hi, p: spark.createDataFrame([("a", "1d", k, p, 1) for k in range(lo, hi)], "ticker string, timeframe string, idx long, prediction double, arrival long")
    L.freeze_partitions(make(0, 20_000, 1.0), path)
    L.freeze_partitions(make(19_000, 21_000, 2.0), path)
    got = spark.read.parquet(path)
    assert got.count() == 21_000 and got.where("prediction = 2.0 AND idx < 20000").count() == 0
    every = got.inputFiles()
    touched = L.frozen_parts(spark, path, [4, 5]).select("idx")
    assert {f.split("part=")[1].split("/")[0] for f in every} == {"0", "1", "2", "3", "4", "5"}
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    assert {r[0] // 4096 for r in touched.collect()} == {4, 5}
