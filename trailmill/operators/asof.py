"""Nearest-in-time joins and range joins.

``prev`` is the last fix strictly before an event, ``next`` the first one at or after it. Both are running values over
events and fixes together (an event stands before a fix of the same time), sorted by time and then by its reverse within
one exchange, not a range join: after the sorts the cost is linear and nothing multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import seconds_between
from . import scan
from .shared import written

#: Dyadic ranges reach over 2 ** _LEVELS bounds of a stream.
_LEVELS = 40


def neighbours(events: DataFrame, fixes: DataFrame, by: list[str], ts: str, tie: list[str], payload: list[str]) -> DataFrame:
    """``events`` with prev_/next_ columns of ``ts`` and ``payload``; events without a time get nulls."""
    cols = [ts, *payload]
    e = events.withColumn("__fix", F.lit(None).cast(fixes.select(F.struct(*cols)).dtypes[0][1])).withColumn("__k", F.lit(0))
    f = fixes.where(F.col(ts).isNotNull()).select(*by, F.col(ts), *(F.col(t) for t in tie if t not in [*by, *cols]), F.struct(*cols).alias("__fix"), F.lit(1).alias("__k"))
    both = e.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.orderBy(F.col(ts).asc_nulls_first(), "__k", *tie)
    # the exact reverse order: both frames only grow, a frame that shrinks would be read again for each row
    back = w.orderBy(F.col(ts).desc_nulls_last(), F.desc("__k"), *(F.desc(t) for t in tie))
    both = both.withColumn("__p", F.last("__fix", ignorenulls=True).over(ahead))
    both = both.withColumn("__n", F.last("__fix", ignorenulls=True).over(back))
    out = both.where("__k = 0")
    timed = F.col(ts).isNotNull()
    for side, c in (("prev", "__p"), ("next", "__n")):
        for x in cols:
            out = out.withColumn(f"{side}_{x}", F.when(timed, F.col(c)[x]))
    return out.drop("__fix", "__k", "__p", "__n")


def nearest(d: DataFrame, ts: str, payload: list[str]) -> DataFrame:
    """From ``neighbours``: near_* of the nearer side (a tie takes the earlier one) and ``signed_s``, fix minus event."""
    before, after = seconds_between(F.col(f"prev_{ts}"), F.col(ts)), seconds_between(F.col(ts), F.col(f"next_{ts}"))
    first = F.coalesce(before <= after, after.isNull())
    for x in payload:
        d = d.withColumn(f"near_{x}", F.when(first, F.col(f"prev_{x}")).otherwise(F.col(f"next_{x}")))
    return d.withColumn("signed_s", F.when(first, -before).otherwise(after))


def backward(d: DataFrame, ts: str, payload: list[str]) -> DataFrame:
    """at_* of the fix at or before the event: of equal times the first."""
    same = F.coalesce(F.col(f"next_{ts}") == F.col(ts), F.lit(False))
    for x in payload:
        d = d.withColumn(f"at_{x}", F.when(same, F.col(f"next_{x}")).otherwise(F.col(f"prev_{x}")))
    return d


def forward(d: DataFrame, ts: str, payload: list[str]) -> DataFrame:
    """at_* of the fix at or after the event."""
    for x in payload:
        d = d.withColumn(f"at_{x}", F.col(f"next_{x}"))
    return d


def locate(d: DataFrame, ts: str, lat: str, lon: str, placed_s: float = 120.0, span_s: float = 600.0) -> DataFrame:
    """From ``neighbours``: a position for each event. The nearest fix within ``placed_s`` places it, interpolated if the
    two fixes around it are at most ``span_s`` apart; else it is tethered to the fix before it (after it if none).
    Adds placement, lat, lon, dt_s; nulls without a time or any fix."""
    before, after = seconds_between(F.col(f"prev_{ts}"), F.col(ts)), seconds_between(F.col(ts), F.col(f"next_{ts}"))
    first = F.coalesce(before <= after, after.isNull())
    dt = F.when(first, before).otherwise(after)
    span = before + after
    part = before / span
    smooth = F.coalesce((span > 0) & (span <= span_s), F.lit(False))
    near = F.coalesce(dt <= placed_s, F.lit(False))
    some = F.col(f"prev_{ts}").isNotNull() | F.col(f"next_{ts}").isNotNull()

    def at(c):
        p, n = F.col(f"prev_{c}"), F.col(f"next_{c}")
        side = F.when(first, p).otherwise(n)
        return F.when(near & smooth, p + (n - p) * part).when(near, side).otherwise(F.coalesce(p, n))

    out_lat, out_lon = at(lat), at(lon)
    d = d.withColumn("placement", F.when(near, "placed").when(some, "tethered"))
    return d.withColumn("at_lat", out_lat).withColumn("at_lon", out_lon).withColumn("dt_s", F.when(near, dt).otherwise(F.coalesce(before, after)))


def count_within(left: DataFrame, right: DataFrame, by: list[str], key: list[str], ts: str, seconds: float) -> DataFrame:
    """``left`` with ``n``: rows of ``right`` in (t, t + seconds]. Running counts over the merged timeline at t and at
    t + seconds, so no row meets another."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    lo = left.select(*by, *key, t.alias("__t"), F.lit(-1).alias("__s"))
    hi = left.select(*by, *key, (t + int(seconds * 1e6)).alias("__t"), F.lit(1).alias("__s"))
    r = right.where(F.col(ts).isNotNull()).select(*by, *(F.lit(None).cast(left.schema[k].dataType).alias(k) for k in key), t.alias("__t"), F.lit(0).alias("__s"))
    w = Window.partitionBy(*by).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    d = lo.union(hi).union(r).withColumn("__c", F.sum(F.when(F.col("__s") == 0, 1).otherwise(0)).over(w))
    return d.where("__s <> 0").groupBy(*by, *key).agg(F.sum(F.col("__c") * F.col("__s")).cast("bigint").alias("n"))


def count_between(left: DataFrame, right: DataFrame, by: list[str], key: list[str], low: str, high: str, at: str, large: bool = False) -> DataFrame:
    """(by, key, n): rows of ``right`` with ``at`` in [low, high] of each row of ``left``; intervals may overlap.

    A sweep: bounds and rows are sorted together, a running count says how many rows lie before each bound, and the
    difference is the answer. ``large`` deals the sweep in segments."""
    mark = lambda c, kind: left.select(*by, *key, F.col(c).alias("__at"), F.lit(kind).alias("__kind"))
    rows = right.where(F.col(at).isNotNull()).select(*by, *(F.lit(None).cast(left.schema[k].dataType).alias(k) for k in key), F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    order = ["__at", "__kind"]
    d = mark(low, 0).union(rows).union(mark(high, 2))
    # equal places are rows of one kind, whose counts don't show until the bound after them
    d = scan.run(scan.deal(d, by, order) if large else d, by, order, __c=scan.total((F.col("__kind") == 1).cast("int")))
    return d.where("__kind <> 1").groupBy(*by, *key).agg(F.sum(F.col("__c") * (F.col("__kind") - 1)).cast("bigint").alias("n"))


def longest_in(sessions: DataFrame, gaps: DataFrame, by: list[str], key: str, low: Column, high: Column, at: str, size: str, payload: list[str], large: bool = False) -> DataFrame:
    """``sessions`` with the ``payload`` of the longest gap whose ``at`` lies in [low, high), unbounded if ``high`` is null;
    ties take the earliest; intervals may overlap.

    A sweep assigns each gap to the piece between two neighbouring bounds. Pieces are summed up over dyadic ranges, and each
    interval asks for the few ranges that it consists of: joins are on (by, level, range), and no interval meets all gaps."""
    order = ["__at", "__kind"]
    sessions = written(sessions, "intervals") if large else sessions
    s = sessions.select(*by, key, low.alias("__lo"), high.alias("__hi"))
    bounds = s.select(*by, F.explode(F.array("__lo", "__hi")).alias("__at")).where(F.col("__at").isNotNull()).distinct().withColumn("__kind", F.lit(0))
    rows = gaps.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(F.col(size).alias("size"), F.struct(*(F.col(c).alias(c) for c in payload)).alias("of")).alias("__gap"))
    d = bounds.unionByName(rows, allowMissingColumns=True)
    d = scan.run(scan.deal(d, by, order) if large else d, by, order, __piece=scan.total((F.col("__kind") == 0).cast("int")))
    early = F.min(F.struct((-F.col("__gap.size")).alias("less"), F.col("__at").alias("at"), F.col("__gap.of").alias("of")))
    pieces = d.where("__kind = 1").groupBy(*by, "__piece").agg(early.alias("__best"))
    levels = F.sequence(F.lit(0), F.lit(_LEVELS))
    up = pieces.withColumn("__level", F.explode(levels)).groupBy(*by, "__level", F.expr("shiftright(__piece, __level)").alias("__range")).agg(F.min("__best").alias("__best"))
    number = d.where("__kind = 0").select(*by, "__at", "__piece")
    lo, hi = number.withColumnsRenamed({"__at": "__lo", "__piece": "__a"}), number.withColumnsRenamed({"__at": "__hi", "__piece": "__b"})
    asked = s.join(lo, [*by, "__lo"]).join(hi, [*by, "__hi"], "left").withColumn("__b", F.coalesce("__b", F.lit(1 << _LEVELS).cast("bigint")))
    # at each level: the range at the left end if its number is odd, the one at the right end if that is
    asked = asked.withColumn("__level", F.explode(levels)).withColumn("__l", F.expr("shiftright(__a + shiftleft(1L, __level) - 1, __level)")).withColumn("__r", F.expr("shiftright(__b, __level)"))
    ends = F.array(F.when(F.col("__l") % 2 == 1, F.col("__l")), F.when((F.col("__r") % 2 == 1) & (F.col("__r") - 1 >= F.col("__l") + F.col("__l") % 2), F.col("__r") - 1))
    asked = asked.where("__l < __r").withColumn("__range", F.explode(F.array_compact(ends)))
    got = asked.join(up, [*by, "__level", "__range"]).groupBy(*by, key).agg(F.min("__best").alias("__best"))
    return sessions.join(got.select(*by, key, *(F.col("__best.of")[c].alias(f"gap_{c}") for c in payload)), [*by, key], "left")


def neighbour_within(left: DataFrame, marks: DataFrame, by: list[str], seq: str, ts: str, rows: int = 60, seconds: float = 15.0) -> DataFrame:
    """``left`` with ``mark_seq``: the nearest mark by record distance, within so many records and seconds; a tie takes
    the earlier. Records are bucketed by distance, so a record meets marks of three buckets only."""
    b = lambda c: F.floor(F.col(c) / rows)
    m = marks.select(*by, F.col(seq).alias("__s"), F.col(ts).alias("__t"), b(seq).alias("__b"))
    near = left.withColumn("__b", F.explode(F.array(b(seq) - 1, b(seq), b(seq) + 1)))
    d = near.join(m, [*by, "__b"]).where((F.abs(F.col("__s") - F.col(seq)) <= rows) & (F.abs(seconds_between(F.col(ts), F.col("__t"))) <= seconds))
    best = d.groupBy(*by, seq).agg(F.min(F.struct(F.abs(F.col("__s") - F.col(seq)).alias("d"), F.col("__s").alias("s"))).alias("m"))
    return left.join(best.select(*by, seq, F.col("m.s").alias("mark_seq")), [*by, seq], "left")
