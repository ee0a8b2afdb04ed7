"""Cases of the third round's findings."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import same_rows
from tidegauge.functions import tables
from tidegauge.operators import aggregates, erasure, frames, joins, programmes, scan, sequence, windows
from tidegauge.plans import audio, registry

#: The 0.95 of these lies half between two whole numbers.
BETWEEN = [1750] * 20 + [1760] * 2


def test_percentiles_round_as_sql_does(spark, duck):
    df = spark.createDataFrame([(0, v) for v in BETWEEN] + [(1, None), (1, -3), (1, 4)], "k int, v long")
    sql = f"SELECT k, round(quantile_cont(v, 0.5))::BIGINT AS p50, round(quantile_cont(v, 0.95))::BIGINT AS p95 FROM (SELECT 0 AS k, unnest({BETWEEN}::BIGINT[]) AS v UNION ALL VALUES (1, NULL), (1, -3), (1, 4)) GROUP BY k"
    assert same_rows(aggregates.percentiles(df, ["k"], "v", [0.5, 0.95]), duck, sql) == 2


def test_trust_rounds_as_sql_does(spark, duck):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(BETWEEN)], "flow_id long, vseq long, drift_us long")
    want = duck.execute(f"SELECT round(quantile_cont(v, 0.95))::BIGINT FROM (SELECT unnest({BETWEEN}::BIGINT[]) AS v)").fetchall()[0][0]
    got = windows.trust(df, ["flow_id"]).first()
    assert (got["p95_us"], got["window_p95_us"], got["p50_us"], got["max_us"], got["samples"]) == (want, want, 1750, 1760, len(BETWEEN))
    running = windows.running_percentile(df, ["flow_id"], "vseq", "drift_us", len(BETWEEN), 0.95).orderBy("vseq").collect()
    assert (running[0]["value"], running[-1]["value"]) == (1750, want)


def test_health_counts_errors_of_the_last_payloads(spark, tmp_path):
    """A flow whose last packet has no payload and whose counter slips ten seconds before the last that has; one
    that is lost on both paths; and one without payloads."""
    import duckdb

    rows = [(i, 0, "view" if i == 351 else "click", 0.0) for i in range(352)] + [(707, 8, "error", 1.0), (708, 16, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert same_rows(entry.queries()["flow_health"](spark, str(tmp_path)), con, registry.SQL["flow_health"]) == 3


def test_tiles_in_many_squares_pair_once(spark):
    """Wide tiles share many squares; equal rows are rows of their own, and no pair is told apart afterwards."""
    r = random.Random(3)
    tiles = [(n, n % 2, r.randrange(-90, 300), r.randrange(-90, 300), r.randrange(1, 200), r.randrange(1, 200)) for n in range(60)]
    tiles.append(tiles[7])
    df = spark.createDataFrame(tiles, "tile_id long, board int, x long, y long, width long, height long")
    want = sorted((a[1], a[0], b[0]) for a in tiles for b in tiles if a[1] == b[1] and a[0] < b[0] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    found = joins.overlapping_tiles(df, "board")
    assert sorted(map(tuple, found.collect())) == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_figures_of_many_frames_are_those_of_each():
    """A batch of frames of two sizes with missing ones; as each alone, and not a call a frame."""
    r = np.random.default_rng(1)
    sizes = [((20, 16), (70, 66))[n % 2] for n in range(9)]
    planes = [None if n == 4 else r.integers(0, 256, w * h, dtype=np.uint8).tobytes() for n, (w, h) in enumerate(sizes)]
    before = [None if n < 3 or p is None else r.integers(0, 256, w * h, dtype=np.uint8).tobytes() for n, (p, (w, h)) in enumerate(zip(planes, sizes, strict=True))]
    rows = frames.all_figures(planes, [w for w, _ in sizes], [h for _, h in sizes], before)
    assert rows[4] == (None,) * 8
    for n, (w, h) in enumerate(sizes):
        if planes[n] is not None:
            y = np.frombuffer(planes[n], np.uint8).reshape(h, w).astype(int)
            moved = None if before[n] is None else np.abs(y - np.frombuffer(before[n], np.uint8).reshape(h, w)).mean()
            want = [y.mean(), frames.blur_variance(y), frames.blockiness(y), frames.black_edges(y), frames.black_edges(y.T)]
            assert np.allclose([rows[n][i] for i in (0, 2, 3, 4, 5)], want) and (rows[n][1] is None) == (moved is None) and (moved is None or np.isclose(rows[n][1], moved))


def test_turns_by_trying_all():
    r = random.Random(5)
    given = [(r.randrange(1 << 33), float(r.choice([1 << 32, 3 << 31, 8_053_063_680])), r.randrange(1 << 32), float(1 << 32), r.randrange(1 << 34)) for _ in range(40)]
    for (raw, wrap, anchor, anchor_wrap, elapsed), got in zip(given, windows.nearest_turns(*np.array(given, float).T, 3).tolist(), strict=True):
        ways = []
        for j in range(-3, 4):
            for m in range(-3, 4):
                whole = raw + m * 2.0**33 - (anchor + j * anchor_wrap)
                d = windows.half_up(np.array(whole + float(windows.half_up(np.array((elapsed - whole) / wrap))) * wrap)).item()
                ways.append((abs(d - elapsed), j, m, d))
        assert (min(ways)[0], min(ways)[3]) == tuple(got)
    assert windows.half_up(np.array([0.5, -0.5, 2.5, -1.4, 0.49999999999999994])).tolist() == [1, -1, 3, -1, 0]


def test_many_cycles_are_solved_in_one_batch(spark):
    """Cells that parities restore, also those of a cycle without any cell; no frame for each cycle."""
    rows = spark.createDataFrame([(f, v, v * 7 % 101) for f in range(3) for v in range(47)], "flow_id long, vseq long, cents long")
    arrived = rows.where("(vseq + flow_id) % 5 != 0 OR vseq % 4 = 1")
    found = sequence.recover(arrived, sequence.parity(rows, 5, 4, ["cents"]), 5, 4, "cents")
    lost = {(r["flow_id"], r["vseq"] // 20, r["vseq"] % 20, r["cents"]) for r in rows.exceptAll(arrived).where("vseq < 40").collect()}
    assert lost and {tuple(r) for r in found.where("cycle < 2").collect()} == lost
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_matrices_are_laid_out_from_arrow():
    """Parts of several matrices, of different lengths and in any order, without Python objects in between."""
    parts = [[(0, 5, b"abc"), (2, 1, b"z"), (1, 0, b"")], [], [(0, 0, b"12345")]]
    listed = [[{"what": w, "at": a, "data": d} for w, a, d in p] for p in parts]
    kind = pa.list_(pa.struct([("what", pa.int32()), ("at", pa.int32()), ("data", pa.binary())]))
    batch = pa.record_batch([pa.array([7, 7, 8]), pa.array([0, 6, 0]), pa.array(listed, kind)], names=["flow_id", "base", "parts"])
    [(rows, have, data)] = erasure._slices(iter([batch]), 3, 2)
    assert rows["flow_id"].tolist() == [7, 7, 8] and sorted(zip(*map(list, np.nonzero(have)), strict=True)) == [(0, 5), (0, 6), (0, 10), (2, 0)]
    assert (bytes(data[0, 5]), bytes(data[0, 10]), bytes(data[2, 0]), int(data[1].sum())) == (b"abc\0\0", b"z\0\0\0\0", b"12345", 0)
    assert [len(rows) for rows, _, _ in erasure._slices(iter([batch.slice(1)]), 3, 2)] == [2]


def test_sections_and_associations_stay_out_of_python(spark):
    """A table of 200 programmes over five cells, one that only names the network, and what is no table or cut off."""
    listed = [(n, 300 + n) for n in range(200)]
    cells = [c for g, entries in enumerate([listed, [(0, 16)]]) for c in tables.cells_of(0, 6 * g, tables.association_body(entries, g + 30, stream=7))]
    rows = [(1, n, (c[1] & 0x1F) << 8 | c[2], c[3] & 15, bool(c[1] & 0x40), c) for n, c in enumerate(cells)]
    found = programmes.sections(programmes.section_parts(spark.createDataFrame(rows, "flow_id long, nr long, pid int, cc int, pusi boolean, cell binary"), "nr"), "nr")
    read = found.select("nr", tables.association("section").alias("a"))
    assert "EvalPython" not in read._jdf.queryExecution().optimizedPlan().toString()
    got = {r["nr"]: (r["a"]["table_stream"], r["a"]["version"], [tuple(p) for p in r["a"]["programs"]]) for r in read.collect()}
    assert got == {len(cells) - 2: (7, 30, listed[1:]), len(cells) - 1: (7, 31, [])}
    odd = spark.createDataFrame([(None,), (b"",), (bytes(7),), (b"\2" + bytes(20),)], "s binary")
    assert [r["v"] for r in odd.select(tables.association("s")["version"].alias("v")).collect()] == [None] * 4
    assert [r["n"] for r in spark.createDataFrame([(bytes(8) + b"\0\1\xe0\5\0\2\xe0" + bytes(4),)], "s binary").select(F.size(tables.association("s")["programs"]).alias("n")).collect()] == [1]


def test_buckets_are_streamed_not_sent_one_by_one(spark):
    """Buckets over several batches stay whole, null values are left out, and no bucket is a group of its own."""
    rows = pd.DataFrame([(k, n // 7, n) for k in range(3) for n in range(k, 40)], columns=["k", "b", "n"])
    for size in (1, 5, 7, 200):
        parts = [f for frames in scan._buckets(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)] + [rows.iloc[:0]]), ["k", "b"]) for f in frames]
        assert [f.values.tolist() for f in parts] == [f.values.tolist() for _, f in rows.groupby(["k", "b"])]
    assert list(scan._buckets(iter([rows.iloc[:0]]), ["k", "b"])) == [[]]
    df = spark.createDataFrame([(k, n, None if n % 5 == 3 else float(n * n % 17)) for k in range(2) for n in range(90)], "k long, n long, v double")
    found = scan.split_ewma(df, ["k"], "n", "v", 0.25, F.floor(F.col("n") / 8))
    want, held = {}, None
    for n in range(90):
        if n % 5 != 3:
            held = float(n * n % 17) if held is None else held * 0.75 + n * n % 17 * 0.25
            want[n] = round(held, 9)
    got = [(r["k"], r["n"], round(r["ewma"], 9)) for r in found.orderBy("k", "n").collect()]
    assert got == [(k, n, v) for k in range(2) for n, v in want.items()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "GroupsInPandas" not in plan and "CoGroup" not in plan


def test_tones_are_made_where_they_are_measured(spark, sf_dir):
    """A row holds what the samples are made of, not the samples."""
    assert {r["n"] for r in audio.tones(spark, sf_dir).select(F.size("pcm").alias("n")).distinct().collect()} == {2}
    assert len(audio.tone([3, 120])) == 2 * audio.FRAME
