"""Sequence operators over ordered records, each in closed form over window functions.

``by`` are the columns of a capture (one ordered stream), ``order`` its order. Every operator is one exchange on
``by``; several on the same ``by`` and ``order`` share it. Order is explicit everywhere, so results don't depend on how
rows are dealt to tasks. Operators that say so take a table dealt in segments (``scan.deal``) too: then no task holds a
whole capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.exprs import haversine_m, seconds_between
from . import scan


def window(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def so_far(by: list[str], order: list[str]) -> WindowSpec:
    return window(by, order).rowsBetween(Window.unboundedPreceding, 0)


def last_known(value: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value up to and with this row."""
    return F.last(value, ignorenulls=True).over(so_far(by, order))


def islands(starts: Column, by: list[str], order: list[str]) -> Column:
    """Running number of the island that each row is in; a row where ``starts`` is true begins one."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(so_far(by, order))


def gaps(df: DataFrame, by: list[str], order: list[str], ts: str, at_least: float) -> DataFrame:
    """Silences between consecutive timed rows of at least so many seconds: one row per gap, the row after it with
    ``start`` (the time before) and ``gap_s``. Takes segments."""
    d = scan.run(df.where(F.col(ts).isNotNull()), by, order, start=scan.previous(F.col(ts)))
    return d.withColumn("gap_s", seconds_between(F.col("start"), F.col(ts))).where(F.col("gap_s") >= at_least)


def _seen(rows: Column, within: float) -> Column:
    """True if a flag holds in ``rows`` (t, f) before one that is more than ``within`` seconds after the first."""
    late = F.transform(rows, lambda x: F.coalesce(x["t"] - rows[0]["t"] > int(within * 1e6), F.lit(False)))
    first_late = F.array_position(late, F.lit(True))
    kept = F.when(first_late > 0, F.slice(rows, F.lit(1), (first_late - 1).cast("int"))).otherwise(rows)
    return F.exists(kept, lambda x: x["f"])


def _timed(ts: str, flag: Column) -> Column:
    return F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.coalesce(flag, F.lit(False)).alias("f"))


def lookahead(df: DataFrame, by: list[str], order: list[str], ts: str, flag: Column, rows: int = 8, within: float = 60.0) -> Column:
    """True if ``flag`` holds in this or one of the next rows, at most ``rows`` in all; the look ends at the first row
    more than ``within`` seconds later. Rows without a time pass."""
    w = window(by, order).rowsBetween(0, rows - 1)
    return _seen(F.collect_list(_timed(ts, flag)).over(w), within)


def look_ahead(df: DataFrame, by: list[str], order: list[str], ts: str, flags: dict[str, Column], rows: int = 8, within: float = 60.0) -> DataFrame:
    """``df`` with a ``lookahead`` of each flag. Takes segments."""
    d = scan.run(df, by, order, **{k: scan.ahead(_timed(ts, f), rows) for k, f in flags.items()})
    return d.withColumns({k: _seen(F.col(k), within) for k in flags})


def classify_gap(banner: Column, alarm: Column, platform: Column) -> Column:
    """death, scheduler-window, suspension or wedge-candidate, from what the look ahead found."""
    return (
        F.when(banner, "death").when((platform == "android") & alarm, "scheduler-window").when(platform == "ios", "suspension").otherwise("wedge-candidate")
    )


def segments(df: DataFrame, by: list[str], order: str, banner: Column, absorb: int = 3) -> Column:
    """Process lifetimes: a banner opens one, but the first banner within ``absorb`` records of the begin belongs to the
    lifetime it finds."""
    w, whole = so_far(by, [order]), Window.partitionBy(*by)
    n = F.sum(F.when(banner, 1).otherwise(0)).over(w)
    first_banner = F.min(F.when(banner, F.col(order))).over(whole)
    first = F.min(F.col(order)).over(whole)
    absorbed = F.coalesce((first_banner - first <= absorb).cast("int"), F.lit(0))
    return F.greatest(n - absorbed, F.lit(0)).cast("int")


def with_segments(df: DataFrame, by: list[str], order: str, banner: Column, absorb: int = 3, out: str = "segment") -> DataFrame:
    """``df`` with the process lifetime of ``segments``. Takes segments of ``scan.deal``."""
    d = scan.run(
        df, by, [order], __n=scan.total(F.when(banner, 1).otherwise(0)), __banner=scan.whole(F.when(banner, F.col(order)), F.min), __first=scan.whole(F.col(order), F.min)
    )
    absorbed = F.coalesce((F.col("__banner") - F.col("__first") <= absorb).cast("int"), F.lit(0))
    return d.withColumn(out, F.greatest(F.col("__n") - absorbed, F.lit(0)).cast("int")).drop("__n", "__banner", "__first")


def state_lane(df: DataFrame, by: list[str], order: list[str], reset: Column, strong: Column, weak: Column, confirm: Column) -> DataFrame:
    """App state per row, with ``boundary`` where any push changed it. Takes segments.

    ``reset`` (a state or null) starts a lifetime, ``strong`` (foreground, background or null) sets the state on the
    same row after it. ``weak`` makes a state that isn't foreground headless, ``confirm`` only an unknown one; both hold
    until the next strong event.
    """
    d = df.withColumn("__r", reset).withColumn("__s", strong).withColumn("__w", F.coalesce(weak, F.lit(False))).withColumn("__c", F.coalesce(confirm, F.lit(False)))
    event, place = F.coalesce("__s", "__r"), F.struct(*order)
    d = scan.run(
        d, by, order, __base=scan.last(event), __at=scan.most(F.when(event.isNotNull(), place)), __weak=scan.most(F.when(F.col("__w"), place)), __conf=scan.most(F.when(F.col("__c"), place))
    )
    # since the last strong event: its place is not after the last weak one
    since = lambda c: F.col(c).isNotNull() & F.coalesce(F.col(c) >= F.col("__at"), F.lit(True))
    base = F.coalesce("__base", F.lit("unknown"))
    state = F.when(base == "foreground", base).when(base == "headless", base).when(since("__weak") | ((base == "unknown") & since("__conf")), "headless").otherwise(base)
    d = scan.run(d.withColumn("state", state), by, order, __s0=scan.previous(F.col("state")))
    s0 = F.col("__s0")
    s1 = F.coalesce(F.col("__r"), s0)
    s2 = F.coalesce(F.col("__s"), s1)
    boundary = s0.isNull() | (s1 != s0) | (s2 != s1) | (F.col("state") != s2)
    return d.withColumn("boundary", boundary).drop("__r", "__s", "__w", "__c", "__base", "__at", "__weak", "__conf", "__s0")


def lane_intervals(lane: DataFrame, by: list[str], order: str, ts: str) -> DataFrame:
    """One row per interval of a ``state_lane``: (by, interval, state, first_seq, last_seq, start, end). Takes segments."""
    d = scan.run(lane, by, [order], interval=scan.total(F.when(F.col("boundary"), 1).otherwise(0)))
    return d.groupBy(*by, "interval").agg(
        F.min_by("state", order).alias("state"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )


def sessions(df: DataFrame, by: list[str], ts: str, tie: list[str], silence: float, least: int = 2) -> DataFrame:
    """Rows with ``session`` (0, 1, …): time-ordered runs split at silences of at least ``silence`` seconds; runs of
    fewer than ``least`` rows are dropped. Takes segments."""
    order = [ts, *tie]
    d = scan.run(df, by, order, __before=scan.previous(F.struct(F.col(ts).alias("t"))))
    d = d.withColumn("__split", F.col("__before").isNull() | F.coalesce(seconds_between(F.col("__before")["t"], F.col(ts)) >= silence, F.lit(False)))
    # a run counts if its first row is followed by enough rows that don't split
    d = scan.run(d, by, order, __look=scan.ahead(F.col("__split"), least))
    long = (F.size("__look") == least) & ~F.exists(F.slice("__look", 2, least), lambda x: x)
    d = d.withColumn("__long", F.when(F.col("__split"), long))
    d = scan.run(d, by, order, __kept=scan.last(F.col("__long")), session=scan.total(F.when(F.col("__long"), 1).otherwise(0)))
    return d.where("__kept").withColumn("session", (F.col("session") - 1).cast("int")).drop("__before", "__split", "__look", "__long", "__kept")


def session_summary(df: DataFrame, by: list[str], ts: str, tie: list[str], lat: str, lon: str) -> DataFrame:
    """(by, session, start, end, n, distance_m) of rows with ``session``. Takes segments."""
    d = scan.run(df, by, [ts, *tie], __before=scan.previous(F.struct("session", F.col(lat).alias("y"), F.col(lon).alias("x"))))
    p = F.col("__before")
    leg = F.when(p["session"] == F.col("session"), haversine_m(p["y"], p["x"], F.col(lat), F.col(lon)))
    return d.withColumn("__leg", F.coalesce(leg, F.lit(0.0))).groupBy(*by, "session").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"), F.sum("__leg").alias("distance_m")
    )


def session_bounds(summary: DataFrame, by: list[str], capture: DataFrame, pad: float = 300.0) -> DataFrame:
    """Padded bounds, in seconds since the epoch: never past the middle of a neighbouring silence nor the capture, whose
    (by, first, last) are in ``capture``."""
    w = window(by, ["session"])
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    d = summary.join(capture, by).withColumn("__a", sec("start")).withColumn("__z", sec("end")).withColumn("__f", sec("first")).withColumn("__l", sec("last"))
    before, after = F.lag("__z").over(w), F.lead("__a").over(w)
    low = F.greatest(F.col("__a") - pad, F.coalesce((before + F.col("__a")) / 2, F.col("__f")), F.col("__f"))
    high = F.least(F.col("__z") + pad, F.coalesce((F.col("__z") + after) / 2, F.col("__l")), F.col("__l"))
    return d.withColumn("low_s", low).withColumn("high_s", high).drop("__a", "__z", "__f", "__l", "first", "last")


def pair_balance(df: DataFrame, by: list[str], order: list[str], first: Column, second: Column) -> DataFrame:
    """(by, firsts, seconds, paired, unpaired, orphans): each second closes one open first; a row can be both. Takes
    segments."""
    seg = scan.segment_of(df, order)
    d = df.select(*by, *order, *([seg] if seg else []), first.cast("int").alias("__f"), second.cast("int").alias("__s"))
    d = scan.run(d, by, order, __d=scan.total(F.col("__f") - F.col("__s")))
    g = d.groupBy(*by).agg(F.sum("__f").alias("firsts"), F.sum("__s").alias("seconds"), F.greatest(F.lit(0), -F.min("__d")).alias("orphans"))
    paired = F.col("seconds") - F.col("orphans")
    return g.withColumn("paired", paired).withColumn("unpaired", F.col("firsts") - paired)


def consume_pairs(df: DataFrame, by: list[str], order: list[str], ts: str, kind: str, fire: str, receipt: str, within: float = 5.0) -> DataFrame:
    """Rows of the two kinds with ``paired_s`` on a receipt that directly follows an unconsumed fire, ``delivered`` if
    that lies in [0, within]. A receipt consumes whatever fire precedes it."""
    w = window(by, order)
    d = df.where(F.col(kind).isin(fire, receipt))
    prev_kind, prev_ts = F.lag(kind).over(w), F.lag(ts).over(w)
    dt = F.when((F.col(kind) == receipt) & (prev_kind == fire), seconds_between(prev_ts, F.col(ts)))
    return d.withColumn("paired_s", dt).withColumn("delivered", F.coalesce(dt.between(0, within), F.lit(False)))


def episodes(df: DataFrame, by: list[str], order: list[str], ts: str, opens: Column, folds: Column, within: float = 5.0) -> DataFrame:
    """Collapse bookkeeping rows into the transition they follow: adds ``episode`` (running number of the transition)
    and ``folded``, true for rows that are suppressed. A bookkeeping row further away than ``within`` ends the
    episode: later rows are not folded either. Without a time nothing is folded or ended."""
    d = df.withColumn("__o", F.coalesce(opens, F.lit(False))).withColumn("__f", F.coalesce(folds, F.lit(False)))
    d = d.withColumn("episode", islands(F.col("__o"), by, order)).withColumn("__t", last_known(F.when(F.col("__o"), F.col(ts)), by, order))
    away = F.abs(seconds_between(F.col("__t"), F.col(ts)))
    far = F.col("__f") & (away > within)
    inside = Window.partitionBy(*by, "episode").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.coalesce(far, F.lit(False))).over(inside)
    return d.withColumn("folded", F.col("__f") & (F.col("episode") > 0) & ~ended & F.coalesce(away <= within, F.lit(False))).drop("__o", "__f", "__t")


def fold_first(df: DataFrame, by: list[str], order: list[str], opens: Column, values: dict[str, Column]) -> DataFrame:
    """(by, order, extra) of the transitions of ``episodes``: the first value that a folded row gives under each name, as a
    map of texts. One aggregation per episode; the row itself is its opening one."""
    place = F.struct(*order)
    told = {k: F.min_by(v, F.when(F.col("folded") & v.isNotNull(), place)) for k, v in values.items()}
    g = df.where("episode > 0").groupBy(*by, "episode").agg(F.min(F.when(opens, place)).alias("__at"), *(v.alias(f"__v_{k}") for k, v in told.items()))
    pairs = F.create_map(*(x for k in values for x in (F.lit(k), F.col(f"__v_{k}").cast("string"))))
    out = g.select(*by, *(F.col("__at")[c].alias(c) for c in order), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("extra"))
    return out.where(F.size("extra") > 0)


def flush_outcomes(df: DataFrame, by: list[str], order: list[str], status: Column, finish: Column, noop: Column, outcome: Column | None = None) -> DataFrame:
    """Finish rows that did something, each with the last ``status`` since the previous such row. No-op finishes are
    dropped and don't reset the status. Rows where ``outcome`` holds are outcomes of their own."""
    real = F.coalesce(finish & ~noop, F.lit(False))
    d = df.withColumn("__real", real).withColumn("__status", status)
    # an effective finish closes its island: the island number counts the finishes before this row
    before = window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__isle", F.coalesce(F.sum(F.col("__real").cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "__isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("last_status", F.last("__status", ignorenulls=True).over(inside))
    keep = F.col("__real") if outcome is None else F.col("__real") | F.coalesce(outcome, F.lit(False))
    return d.where(keep).drop("__real", "__status", "__isle")


def cadence(df: DataFrame, by: list[str], order: list[str], ts: str) -> DataFrame:
    """(by, n, median_s, max_s) of the intervals between consecutive rows."""
    d = df.withColumn("__dt", seconds_between(F.lag(ts).over(window(by, order)), F.col(ts)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.median("__dt").alias("median_s"), F.max("__dt").alias("max_s"))


def dwell_ratio(df: DataFrame, by: list[str], order: list[str], ts: str, state: str, end: str) -> DataFrame:
    """(by, flips, on_s, span_s, ratio): time with ``state`` true from each row to the next, the last to ``end``."""
    w = window(by, order)
    d = df.withColumn("__dt", seconds_between(F.col(ts), F.coalesce(F.lead(ts).over(w), F.col(end)))).withColumn("__flip", F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(False)))
    g = d.groupBy(*by).agg(F.count_if("__flip").alias("flips"), F.sum(F.when(F.col(state), F.col("__dt")).otherwise(0.0)).alias("on_s"), F.sum("__dt").alias("span_s"))
    return g.withColumn("ratio", F.when(F.col("span_s") > 0, F.col("on_s") / F.col("span_s")))


def change_count(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, n, changes): how often consecutive values differ."""
    d = df.withColumn("__x", F.coalesce(F.col(value) != F.lag(value).over(window(by, order)), F.lit(False)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("__x").alias("changes"))


def last_state(df: DataFrame, by: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """(by, …): for each named expression its last non-null value."""
    return df.groupBy(*by).agg(*(F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col(order))).alias(k) for k, v in values.items()))


def track(df: DataFrame, by: list[str], ts: str, tie: list[str], lat: str, lon: str, split: float = 900.0, breaks: Column | None = None, least: int = 2) -> DataFrame:
    """Vertices of track lines: time-ordered, split at silences of at least ``split`` seconds and where ``breaks`` holds,
    repeated positions dropped, runs of fewer than ``least`` vertices dropped; adds ``run`` and ``vertex``."""
    order = [ts, *tie]
    w = window(by, order)
    cut = seconds_between(F.lag(ts).over(w), F.col(ts)) >= split
    if breaks is not None:
        cut = cut | breaks
    d = df.withColumn("run", islands(F.coalesce(cut, F.lit(False)), by, order))
    r = Window.partitionBy(*by, "run").orderBy(*order)
    same = (F.lag(lat).over(r) == F.col(lat)) & (F.lag(lon).over(r) == F.col(lon))
    d = d.withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same")).drop("__same")
    d = d.withColumn("vertex", F.row_number().over(r) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by, "run")))
    return d.where(F.col("__n") >= least).drop("__n")


def connectors(df: DataFrame, by: list[str], order: list[str], moving: str, keep: list[str]) -> DataFrame:
    """Each stationary row and the next moving one: moving rows whose predecessor among rows with a direction is
    stationary, with its ``keep`` columns as ``from_*``."""
    w = window(by, order)
    d = df.where(F.col(moving).isNotNull())
    for c in [moving, *keep]:
        d = d.withColumn(f"from_{c}", F.lag(c).over(w))
    return d.where(F.col(moving) & ~F.col(f"from_{moving}")).drop(f"from_{moving}")


def clip_legs(vertices: DataFrame, by: list[str], order: list[str], ts: str, low: Column, high: Column) -> DataFrame:
    """Legs of a polyline that overlap [low, high], with ``piece``: maximal runs of consecutive ones."""
    w = window(by, order)
    d = vertices.withColumn("__next", F.lead(ts).over(w)).withColumn("leg", F.row_number().over(w) - 1).where(F.col("__next").isNotNull())
    d = d.where((F.col(ts) <= high) & (F.col("__next") >= low))
    jump = F.col("leg") - F.lag("leg").over(w) != 1
    return d.withColumn("leg_end", F.col("__next")).drop("__next").withColumn("piece", islands(F.coalesce(jump, F.lit(False)), by, order))


def year_offset(df: DataFrame, month: str, by: list[str], order: list[str], out: str = "years") -> DataFrame:
    """Add the years passed so far: each step from December to January adds one. Takes segments."""
    d = scan.run(df, by, order, __prev=scan.previous(F.col(month)))
    step = F.coalesce((F.col("__prev") == 12) & (F.col(month) == 1), F.lit(False))
    return scan.run(d.withColumn("__step", step.cast("int")), by, order, **{out: scan.total(F.col("__step"))}).drop("__prev", "__step")
