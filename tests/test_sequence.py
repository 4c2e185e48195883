"""Closed forms against small sequential loops on random sequences, shuffled before they reach Spark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmill.operators import asof as J
from trailmill.operators import sequence as S

T0 = datetime(2024, 1, 1)
BY, ORDER = ["c"], ["seq"]


def frame(spark, rows, schema):
    rows = list(rows)
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def captures(seed, n=60, length=14):
    rnd = random.Random(seed)
    for c in range(n):
        yield c, rnd, range(rnd.randint(1, length))


def test_gap_boundary(spark):
    rows = [(0, 0, T0), (0, 1, T0 + timedelta(seconds=899)), (0, 2, None), (0, 3, T0 + timedelta(seconds=899 + 900))]
    got = S.gaps(frame(spark, rows, "c int, seq int, ts timestamp_ntz"), BY, ORDER, "ts", 900.0).collect()
    assert [(r.seq, r.gap_s) for r in got] == [(3, 900.0)]


def test_lookahead_stops_at_the_first_late_row(spark):
    at = [0, 60, 61, 5]
    rows = [(0, i, T0 + timedelta(seconds=s), i in (1, 3)) for i, s in enumerate(at)]
    d = frame(spark, rows, "c int, seq int, ts timestamp_ntz, f boolean")
    got = {r.seq: r.x for r in d.withColumn("x", S.lookahead(d, BY, ORDER, "ts", F.col("f"))).collect()}
    assert got[0] is True and got[2] is True and got[3] is True
    rows = [(0, 0, T0, False), (0, 1, T0 + timedelta(seconds=61), False), (0, 2, T0 + timedelta(seconds=5), True)]
    d = frame(spark, rows, "c int, seq int, ts timestamp_ntz, f boolean")
    assert {r.seq: r.x for r in d.withColumn("x", S.lookahead(d, BY, ORDER, "ts", F.col("f"))).collect()}[0] is False


def test_segments(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(1):
        cur, start, version = 0, 0, False
        for i in seqs:
            b = rnd.random() < 0.2
            if b:
                if not version and cur == 0 and i - start <= 3:
                    version = True
                else:
                    cur, start, version = cur + 1, i, True
            rows.append((c, i, b))
            want[c, i] = cur
    d = frame(spark, rows, "c int, seq int, b boolean")
    got = {(r.c, r.seq): r.s for r in d.withColumn("s", S.segments(d, BY, "seq", F.col("b"))).collect()}
    assert got == want


def test_state_lane_and_boundaries(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(2, 120):
        state = None
        for i in seqs:
            reset = rnd.choice([None] * 6 + ["headless", "unknown"]) if i else None
            strong = rnd.choice([None] * 4 + ["foreground", "background"])
            weak, conf = rnd.random() < 0.2, rnd.random() < 0.2
            boundary = state is None
            state = state or "unknown"
            for push in (reset, strong):
                if push and push != state:
                    state, boundary = push, True
            if weak and state not in ("foreground", "headless"):
                state, boundary = "headless", True
            if conf and state == "unknown":
                state, boundary = "headless", True
            rows.append((c, i, reset, strong, weak, conf))
            want[c, i] = (state, boundary)
    d = frame(spark, rows, "c int, seq int, r string, s string, w boolean, k boolean")
    got = S.state_lane(d, BY, ORDER, F.col("r"), F.col("s"), F.col("w"), F.col("k")).collect()
    bad = [(r.c, r.seq, r.state, r.boundary, want[r.c, r.seq]) for r in got if (r.state, r.boundary) != want[r.c, r.seq]]
    assert not bad


def test_pair_balance(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(3):
        depth = orphans = paired = firsts = 0
        for i in seqs:
            a, b = rnd.random() < 0.4, rnd.random() < 0.4
            if a:
                depth, firsts = depth + 1, firsts + 1
            if b:
                if depth:
                    depth, paired = depth - 1, paired + 1
                else:
                    orphans += 1
            rows.append((c, i, a, b))
        want[c] = (paired, firsts - paired, orphans)
    d = frame(spark, rows, "c int, seq int, a boolean, b boolean")
    got = {r.c: (r.paired, r.unpaired, r.orphans) for r in S.pair_balance(d, BY, ORDER, F.col("a"), F.col("b")).collect()}
    assert {k: v for k, v in want.items() if k in got} == got


def test_consume_pairs(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(4):
        t, open_ = T0, None
        for i in seqs:
            t += timedelta(seconds=rnd.choice([-1, 0, 1, 4, 5, 6]))
            kind = rnd.choice(["fire", "receipt", "other"])
            rows.append((c, i, t, kind))
            if kind == "fire":
                open_ = t
            elif kind == "receipt":
                dt = None if open_ is None else (t - open_).total_seconds()
                want[c, i] = dt is not None and 0 <= dt <= 5
                open_ = None
    d = frame(spark, rows, "c int, seq int, ts timestamp_ntz, kind string")
    got = S.consume_pairs(d, BY, ORDER, "ts", "kind", "fire", "receipt").where("kind = 'receipt'").collect()
    assert {(r.c, r.seq): r.delivered for r in got} == want


def test_episodes(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(5):
        t, start, closed = T0, None, True
        for i in seqs:
            t += timedelta(seconds=rnd.choice([0, 1, 3, 6]))
            kind = rnd.choice(["open", "book", "other"])
            rows.append((c, i, t, kind))
            folded = False
            if kind == "open":
                start, closed = t, False
            elif kind == "book" and start is not None and not closed:
                if abs((t - start).total_seconds()) <= 5:
                    folded = True
                else:
                    closed = True
            want[c, i] = folded
    d = frame(spark, rows, "c int, seq int, ts timestamp_ntz, kind string")
    got = S.episodes(d, BY, ORDER, "ts", F.col("kind") == "open", F.col("kind") == "book").collect()
    assert {(r.c, r.seq): r.folded for r in got} == want


def test_flush_outcomes(spark):
    rows, want = [], {}
    for c, rnd, seqs in captures(6):
        status = None
        for i in seqs:
            kind = rnd.choice(["status", "finish", "noop", "x"])
            s = rnd.randint(1, 9) if kind == "status" else None
            rows.append((c, i, kind, s))
            if s is not None:
                status = s
            if kind == "finish":
                want[c, i] = status
                status = None
    d = frame(spark, rows, "c int, seq int, kind string, s int")
    got = S.flush_outcomes(d, BY, ORDER, F.col("s"), F.col("kind").isin("finish", "noop"), F.col("kind") == "noop").collect()
    assert {(r.c, r.seq): r.last_status for r in got} == want


@pytest.mark.parametrize("silence,n", [(1199, 1), (1200, 2)])
def test_session_boundary(spark, silence, n):
    ts = [0, 10, 10 + silence, 20 + silence, 99999]
    d = frame(spark, [(0, i, T0 + timedelta(seconds=s)) for i, s in enumerate(ts)], "c int, seq int, ts timestamp_ntz")
    got = S.sessions(d, BY, "ts", ORDER, 1200.0)
    assert got.select("session").distinct().count() == n and got.count() == 4


def test_locate_against_bisect(spark):
    from bisect import bisect_left

    ev, fx, want = [], [], {}
    for c, rnd, seqs in captures(8, 80):
        fixes = sorted((T0 + timedelta(seconds=rnd.randint(0, 1500)), rnd.random() * 80, rnd.random() * 170) for _ in range(rnd.randint(0, 6)))
        fixes = [f for i, f in enumerate(fixes) if not i or f[0] != fixes[i - 1][0]]
        fx += [(c, 1000 + i, *f) for i, f in enumerate(fixes)]
        times = [f[0] for f in fixes]
        for i in seqs:
            t = T0 + timedelta(seconds=rnd.randint(0, 1500)) if rnd.random() < 0.8 or not times else rnd.choice(times)
            ev.append((c, i, t))
            k = bisect_left(times, t)
            p, n = (fixes[k - 1] if k else None), (fixes[k] if k < len(times) else None)
            b, a = ((t - p[0]).total_seconds() if p else None), ((n[0] - t).total_seconds() if n else None)
            if p is None and n is None:
                want[c, i] = (None, None, None)
                continue
            near, dt = (p, b) if a is None or (b is not None and b <= a) else (n, a)
            if dt <= 120:
                lat = near[1]
                if p and n and 0 < a + b <= 600:
                    lat = p[1] + (n[1] - p[1]) * b / (a + b)
                want[c, i] = ("placed", round(lat, 6), dt)
            else:
                anchor, d = (p, b) if p else (n, a)
                want[c, i] = ("tethered", round(anchor[1], 6), d)
    e = frame(spark, ev, "c int, seq int, ts timestamp_ntz")
    f = frame(spark, fx, "c int, seq int, ts timestamp_ntz, lat double, lon double")
    got = J.locate(J.neighbours(e, f, BY, "ts", ["seq"], ["lat", "lon"]), "ts", "lat", "lon").collect()
    assert {(r.c, r.seq): (r.placement, None if r.at_lat is None else round(r.at_lat, 6), r.dt_s) for r in got} == want


@pytest.mark.parametrize("dt,kind", [(120.0, "placed"), (120.1, "tethered")])
def test_placement_boundary(spark, dt, kind):
    e = frame(spark, [(0, 0, T0 + timedelta(seconds=dt))], "c int, seq int, ts timestamp_ntz")
    f = frame(spark, [(0, 9, T0, 1.0, 2.0)], "c int, seq int, ts timestamp_ntz, lat double, lon double")
    assert J.locate(J.neighbours(e, f, BY, "ts", ["seq"], ["lat", "lon"]), "ts", "lat", "lon").first().placement == kind


def test_count_within_is_half_open(spark):
    left = frame(spark, [(0, 0, T0)], "c int, seq int, ts timestamp_ntz")
    right = frame(spark, [(0, i, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 1, 60, 61])], "c int, seq int, ts timestamp_ntz")
    assert J.count_within(left, right, BY, ["seq"], "ts", 60.0).first().n == 2


def test_neighbour_within_ties_to_the_earlier(spark):
    left = frame(spark, [(0, 100, T0)], "c int, seq int, ts timestamp_ntz")
    marks = frame(spark, [(0, 90, T0), (0, 110, T0), (0, 161, T0)], "c int, seq int, ts timestamp_ntz")
    assert J.neighbour_within(left, marks, BY, "seq", "ts").first().mark_seq == 90


def test_track_drops_repeats_and_short_runs(spark):
    at = [(0, 1, 1), (10, 1, 1), (20, 2, 2), (2000, 3, 3), (4000, 4, 4), (4010, 5, 5)]
    d = frame(spark, [(0, i, T0 + timedelta(seconds=s), float(a), float(b)) for i, (s, a, b) in enumerate(at)], "c int, seq int, ts timestamp_ntz, lat double, lon double")
    got = S.track(d, BY, "ts", ORDER, "lat", "lon").orderBy("ts").collect()
    assert [(r.seq, r.vertex) for r in got] == [(0, 0), (2, 1), (4, 0), (5, 1)]


def test_distance_of_a_first_vertex_is_zero(spark):
    d = frame(spark, [(0, 0, T0, 45.0, 7.0, 0), (0, 1, T0 + timedelta(seconds=1), 45.01, 7.0, 0)], "c int, seq int, ts timestamp_ntz, lat double, lon double, session int")
    assert S.session_summary(d, BY, "ts", ORDER, "lat", "lon").first().distance_m == pytest.approx(1111.95, abs=0.1)
