"""Golden cases of stalls, silence, holds, leg states, bounded channels, and of folders and configurations."""

import json

from pyspark.sql import functions as F

from tidegauge.operators import aggregates, sequence, windows
from tidegauge.sources import export, library

SECOND = 1_000_000


def test_slots_stall_once_after_the_grace(spark):
    """Slot 1 is quiet from second 12 to 20, 2 never has data, 3 is sparse, 4 is quiet before the grace ends."""
    slots = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "pid long, continuous boolean").withColumns({"start_us": F.lit(0).cast("long"), "until_us": F.lit(30 * SECOND).cast("long")})
    seen = [(1, s) for s in [*range(1, 13), *range(20, 31)]] + [(4, s) for s in [1, 9, *range(10, 31)]]
    units = spark.createDataFrame([(p, s * SECOND) for p, s in seen], "pid long, at long")
    got = {tuple(r) for r in windows.slot_stalls(units, slots, ["pid"], "at").collect()}
    assert got == {(1, 17, 20), (2, 10, None)}


def test_silence_needs_two_seconds_and_a_finite_loudness(spark):
    rows = [(t * 500_000, x, b) for t, (x, b) in enumerate([(-70.0, 0), (-60.0, 0), (float("-inf"), 0), (-61.0, 0), (None, 10), (-80.0, 0), (None, 900), (-60.0, 0), (-59.9, 0)])]
    df = spark.createDataFrame(rows, "at long, m double, bps long").withColumn("pid", F.lit(1))
    got = aggregates.held_for(df, ["pid"], "at", aggregates.silent(F.col("m"), F.col("bps")), 2 * SECOND).collect()
    assert [tuple(r) for r in got] == [(1, 1_500_000, 3_500_000, 3_500_000)]
    assert aggregates.held_for(df.limit(0), ["pid"], "at", F.lit(True), 1).count() == 0


def test_hard_mute_is_all_channels(spark):
    rows = [(1, i, [0.0, 0.0 if i % 100 < 45 else 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, "pid long, frame long, channels array<double>")
    got = [tuple(r)[1:] for r in aggregates.hard_mutes(df, ["pid"], "frame", "channels", 1000).orderBy("begin").collect()]
    assert got == [(0, 39, 44, 45), (100, 139, 144, 45)]


def test_peaks_are_held(spark):
    s = aggregates.PeakHold()
    shown = [s.add(t, p) for t, p in [(0, -20.0), (SECOND, -30.0), (1_499_999, -25.0), (1_500_000, -40.0), (2_000_000, -10.0), (3_499_999, -50.0), (3_500_000, -50.0)]]
    assert shown == [-20.0, -20.0, -20.0, -40.0, -10.0, -10.0, -50.0]


def test_a_leg_that_stays_away_is_down(spark):
    rows = [(1, 0, t * SECOND // 2) for t in range(20)] + [(1, 1, t * SECOND // 2) for t in [0, 1, 2, 6, 7]]
    legs = spark.createDataFrame(rows, "flow_id long, leg int, recv_leg_us long").withColumn("event_id", F.monotonically_increasing_id())
    got = {tuple(r) for r in sequence.leg_down(legs).collect()}
    assert got == {(1, 1, 2 * SECOND, 3 * SECOND), (1, 1, 4_500_000, None)}


def test_output_changes_over_between_legs(spark):
    rows = [(1, v, leg, v * 100 + (leg if v % 4 < 2 else 1 - leg)) for v in range(8) for leg in (0, 1)] + [(1, 8, 1, 900)]
    legs = spark.createDataFrame(rows, "flow_id long, vseq long, leg int, recv_leg_us long")
    got = {tuple(r) for r in sequence.red_blue(legs).collect()}
    assert got == {(1, 0, 8, 4, 4, 1), (1, 1, 9, 5, 4, 2)}


def test_matrix_moves_over_the_wrap(spark):
    df = spark.createDataFrame([(65530, 65534, [65530, 65535, 3]), (10, 65530, [10, 12]), (10, 5, [10, 28])], "base long, new long, seqs array<long>")
    got = [r[0] for r in df.select(sequence.realigned(F.col("base"), F.col("new"), F.col("seqs"), 20)).collect()]
    assert got == [[1, 5], [16, 18], [5]]
    assert spark.range(1).select(sequence.realigned(F.lit(100), F.lit(120), F.array(F.lit(100)), 20)).first()[0] is None


def test_full_channels_drop(spark):
    c = export.Channel(2, 1)
    assert [c.send(t) for t in (0, 0, 0, SECOND, SECOND, 9 * SECOND)] == [True, True, False, True, False, True] and c.dropped == 2


def test_configurations_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"flows": [{"id": "f1", "name": "one", "enabled": True, "input_ids": ["i1"], "more": 1}], "inputs": [{"id": "i1", "name": "in", "type": "rtp"}]}, indent=1))
    (tmp_path / "b.json").write_text("no json")
    configs = library.read_configs(spark, str(tmp_path / "*.json"))
    assert [(r["id"], r["input_ids"], r["output_ids"]) for r in library.dimension(configs, "flows").collect()] == [("f1", ["i1"], None)]
    assert library.dimension(configs, "inputs", "i2").count() == 0 and library.dimension(configs, "outputs").count() == 0
    inputs = library.dimension(configs, "inputs", "i1")
    secrets = inputs.select("node", "id", F.lit("key").alias("settings"))
    assert [r["settings"] for r in library.with_secrets(inputs, secrets).collect()] == ["key"]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one two.ts").write_bytes(b"\x47" * 188)
    files = library.media_files(spark, str(tmp_path))
    assert {(r["name"], r["size_bytes"]) for r in files.collect()} >= {("one two.ts", 188), ("b.json", 7)}
    assert {r["ending"]: r["files"] for r in library.library_use(files).collect()} == {"json": 2, "ts": 1}
