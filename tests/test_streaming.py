import datetime as dt
import os
import tempfile

import pytest

from riskspark.streaming import monitor as mon


SCHEMA = "window_start timestamp, bin int, n long"
D1, D2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def held(table):
    return sorted((r.window_start, r.bin, r.n) for r in table.read().collect())


def test_count_table_keeps_the_latest_row_of_a_key(spark):
    base = tempfile.mkdtemp(prefix="riskspark-counts-")
    t = mon.CountTable(spark, base)
    t.merge(spark.createDataFrame([(D1, 0, 5), (D1, 1, 2)], SCHEMA), 0)
    second = spark.createDataFrame([(D1, 1, 7), (D2, 3, 1)], SCHEMA)
    t.merge(second, 1)
    t.merge(second, 1)                                              # a replayed epoch
    assert held(t) == [(D1, 0, 5), (D1, 1, 7), (D2, 3, 1)]
    again = mon.CountTable(spark, base)                             # a new stream over the old table, from epoch 0
    again.merge(spark.createDataFrame([(D1, 1, 8)], SCHEMA), 0)
    assert held(again) == held(mon.CountTable(spark, base)) == [(D1, 0, 5), (D1, 1, 8), (D2, 3, 1)]
    again.compact()
    assert len(again.committed()) == 1 and held(again) == [(D1, 0, 5), (D1, 1, 8), (D2, 3, 1)]
    again.merge(spark.createDataFrame([(D2, 3, 2)], SCHEMA), 0)
    assert held(mon.CountTable(spark, base)) == [(D1, 0, 5), (D1, 1, 8), (D2, 3, 2)]


def test_an_epoch_writes_what_it_changed(spark):
    base = tempfile.mkdtemp(prefix="riskspark-counts-")
    t = mon.CountTable(spark, base)
    t.merge(spark.range(5000).selectExpr("timestamp_seconds(id * 86400) window_start", "int(id % 10) bin", "id n"), 0)
    t.merge(spark.createDataFrame([(D1, 1, 7)], SCHEMA), 1)
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    first, second = t.committed()
    assert size(second) < size(first) / 5


def test_an_unfinished_epoch_is_not_read(spark):
    base = tempfile.mkdtemp(prefix="riskspark-counts-")
    t = mon.CountTable(spark, base)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.merge(spark.createDataFrame([(D1, 0, 5)], SCHEMA), 0)
    t.merge(spark.createDataFrame([(D1, 0, 6)], SCHEMA), 1)
    os.remove(t.committed()[1] + "/_SUCCESS")
    assert held(t) == [(D1, 0, 5)]


def test_psi_by_window_matches_hand_computation(spark):
    import datetime as dt
    import math
    d1 = dt.datetime(2024, 1, 1)
    counts = spark.createDataFrame([(d1, 0, 30), (d1, 1, 70)], "window_start timestamp, bin int, n long")
    base = spark.createDataFrame([(0, 0.5), (1, 0.5)], "bin int, e double")
    r = mon.psi_by_window(counts, base).first()
    want = (0.3 - 0.5) * math.log(0.3 / 0.5) + (0.7 - 0.5) * math.log(0.7 / 0.5)
    assert abs(r.psi - want) < 1e-6 and r.n_events == 100


def test_stream_equals_batch(spark):
    import uuid

    src = "/root/testdata/sf0.001"
    run = tempfile.mkdtemp(prefix="riskspark-stream-")
    table = mon.CountTable(spark, f"{run}/counts")
    mon.run_count_stream(spark, mon.event_stream(spark, src), table, f"{run}/ckpt-{uuid.uuid4().hex[:6]}")
    streamed = {(r.window_start, r.bin): r.n for r in table.read().collect()}
    batch = mon.daily_bin_counts(mon.scored_events(spark.read.parquet(f"{src}/events.parquet")))
    want = {(r.window_start, r.bin): r.n for r in batch.collect()}
    assert streamed == want and sum(want.values()) == spark.read.parquet(f"{src}/events.parquet").count()



def test_a_new_stream_over_an_old_table_equals_batch(spark):
    src = "/root/testdata/sf0.001"
    run = tempfile.mkdtemp(prefix="riskspark-stream-")
    for k in range(2):
        table = mon.CountTable(spark, f"{run}/counts")
        mon.run_count_stream(spark, mon.event_stream(spark, src), table, f"{run}/ckpt-{k}")
    streamed = {(r.window_start, r.bin): r.n for r in table.read().collect()}
    want = {(r.window_start, r.bin): r.n for r in mon.daily_bin_counts(mon.scored_events(spark.read.parquet(f"{src}/events.parquet"))).collect()}
    assert streamed == want
