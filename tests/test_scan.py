"""Running values over dealt segments equal those of plain windows; sweeps over overlapping intervals equal loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import asof, scan
from trailmill.operators import sequence as S
from trailmill.sources import records as R

T0 = dt.datetime(2024, 1, 1)


def stream(spark, n=900, seed=3):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 1, 5, 20, 400, 1300])
        rows.append((rnd.choice(["big", "big", "big", "big", "small", None]), i, rnd.choice([None, T0 + dt.timedelta(seconds=t), T0 + dt.timedelta(seconds=t)]), rnd.choice(["a", "b", "c", None]), rnd.randrange(12) + 1))
    return spark.createDataFrame(rows, "k string, seq int, ts timestamp_ntz, kind string, month int")


def same(a, b):
    cols = [c for c in a.columns if not c.startswith("__segment")]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(a) == key(b)


def both(spark, f, order=("seq",), df=None):
    d = stream(spark) if df is None else df
    dealt = scan.deal(d, ["k"], list(order), 50)
    assert dealt.select(scan.segment_column(list(order))).distinct().count() > 5
    same(f(d), f(dealt))


def test_every_running_value(spark):
    v = F.col("month")
    value = F.when(F.col("kind").isNotNull(), v)
    both(spark, lambda d: scan.run(
        d, ["k"], ["seq"], a=scan.total(v), b=scan.total_before(v), c=scan.most(value), d=scan.last(value), e=scan.previous(F.col("kind")),
        f=scan.following(F.col("kind")), g=scan.whole(v, F.max), h=scan.ahead(F.col("kind"), 5), i=scan.ahead(v, 1),
    ))


def test_sequence_operators(spark):
    kind = F.col("kind")
    both(spark, lambda d: S.gaps(d, ["k"], ["seq"], "ts", 300.0))
    both(spark, lambda d: S.look_ahead(d, ["k"], ["seq"], "ts", {"x": kind == "a"}))
    both(spark, lambda d: S.with_segments(d, ["k"], "seq", kind == "c"))
    both(spark, lambda d: S.year_offset(d, "month", ["k"], ["seq"]))
    both(spark, lambda d: S.pair_balance(d, ["k"], ["seq"], F.coalesce(kind == "a", F.lit(False)), F.coalesce(kind == "b", F.lit(False))))

    def lane(d):
        reset, strong = F.when(F.col("month") == 1, "unknown").when(F.col("month") == 2, "headless"), F.when(kind == "a", "foreground").when(kind == "b", "background")
        return S.state_lane(d, ["k"], ["seq"], reset, strong, F.col("month") > 10, kind == "c")

    both(spark, lane)
    both(spark, lambda d: S.lane_intervals(lane(d), ["k"], "seq", "ts"))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_sessions(spark, least):
    timed = stream(spark).where("ts is not null").withColumn("lat", F.col("month") * 1.0).withColumn("lon", F.col("seq") / 10)
    both(spark, lambda d: S.sessions(d, ["k"], "ts", ["seq"], 1200.0, least), ("ts", "seq"), timed)

    def summary(d):
        s = S.session_summary(S.sessions(d, ["k"], "ts", ["seq"], 1200.0, least), ["k"], "ts", ["seq"], "lat", "lon")
        return s.withColumn("distance_m", F.round("distance_m", 3))

    both(spark, summary, ("ts", "seq"), timed)


def test_records_of_one_large_capture(spark):
    lines = [(c, y, i, text) for c, y in (("x", 2023), ("y", 2024)) for i, text in enumerate(
        ["lost", *(x for n in range(150) for x in ([f"{'12-31' if n % 50 < 25 else '01-01'} 10:00:{n % 60:02d}.000 DEBUG [Cls m{n}] head", "  body", ""][: n % 3 + 1]))], 1)]
    df = spark.createDataFrame(lines, "capture_id string, year int, line_no bigint, line string")
    a, b = R.android_records(df), R.android_records(scan.deal(df, ["capture_id"], ["line_no"], 40))
    assert scan.segment_of(b, ["seq"])
    same(a, b)


def test_only_large_streams_are_dealt(spark):
    d = stream(spark)
    assert scan.segment_of(scan.deal_if_large(d, ["k"], ["seq"], 10_000), ["seq"]) is None
    assert scan.segment_of(scan.deal_if_large(d, ["k"], ["seq"], 100), ["seq"])
    assert scan.segment_of(scan.deal(d, ["k"], ["seq"], 100), ["ts"]) is None


@pytest.mark.parametrize("large", [False, True])
def test_sweeps_over_overlapping_intervals(spark, large):
    rnd = random.Random(9)
    left = [(k, i, rnd.randrange(100), None) for k in "xy" for i in range(40)]
    left = [(k, i, lo, rnd.choice([None, lo, lo + rnd.randrange(60)])) for k, i, lo, _ in left]
    right = [(k, rnd.randrange(-5, 170), rnd.randrange(6), j) for k in "xyz" for j in range(120)]
    s, g = spark.createDataFrame(left, "k string, i int, lo int, hi int"), spark.createDataFrame(right, "k string, at int, size int, name int")
    got = {(r.k, r.i): (r.gap_size, r.gap_at) for r in asof.longest_in(s, g, ["k"], "i", F.col("lo"), F.col("hi"), "at", "size", ["size", "at"], large).collect()}
    n = {(r.k, r.i): r.n for r in asof.count_between(s.fillna(1000), g, ["k"], ["i"], "lo", "hi", "at", large).collect()}
    for k, i, lo, hi in left:
        mine = [(-size, at) for kk, at, size, _ in right if kk == k and at >= lo and (hi is None or at < hi)]
        want = min(mine, default=(None, None))
        assert got[k, i] == (None if want[0] is None else -want[0], want[1])
        assert n[k, i] == sum(kk == k and lo <= at <= (1000 if hi is None else hi) for kk, at, _, _ in right)


def test_prefix_ladder_against_pairs(spark):
    from trailmill.sources import captures as C

    rnd = random.Random(4)
    base = ["".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 3, 5, 9, 17, 300, 700)]
    texts = [b[: rnd.randint(0, len(b))] + rnd.choice(["", "", "x", "ab"]) for b in base * 12] + ["ü" * 5, "ü" * 4, "😀b", "😀", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.k: r.duplicate for r in C.duplicates(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    plain = [t or "" for t in texts]
    assert got == {i: any((u == t and j < i) or (len(u) > len(t) and u.startswith(t)) for j, u in enumerate(plain)) for i, t in enumerate(plain)}
    assert C.duplicates(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0
    alone = C.duplicates(spark.createDataFrame([(1, ""), (2, "")], "k int, t string"), "k", "t").collect()
    assert {r.k: r.duplicate for r in alone} == {1: False, 2: True}
