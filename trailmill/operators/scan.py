"""Running values over ordered streams, also over streams that no single task should hold.

A window over a stream's key is one task per stream. ``deal`` cuts streams in segments instead: range partitions by key and
order, written once, so that every later step sees the same cuts. A running value then has two levels: a window inside
each segment; one summary per segment, carried over the few segments of a stream, and joined back. ``run`` does so for a table
that was dealt in the order asked for, and takes the plain window for one that was not; both give the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .shared import written

_UPTO = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)
_NTH = "__nth"


def segment_column(order: list[str]) -> str:
    return "__segment_" + "_".join(order)


def segment_of(df: DataFrame, order: list[str]) -> str | None:
    """The column of ``df``'s segments if it was dealt in this order."""
    name = segment_column(order)
    return name if name in df.columns else None


def deal(df: DataFrame, by: list[str], order: list[str], rows: int = 1_000_000, cut: list[str] | None = None, parts: int | None = None, weight: Column | None = None) -> DataFrame:
    """``df`` in segments of about ``rows`` rows, or ``parts`` segments, by ``by`` and ``order``; rows of equal ``by`` and
    ``order`` share one. Where the last columns of ``order`` are large, ``cut`` names the first ones that decide alone: their
    values are sampled. A row of ``weight`` w counts as w rows where the cuts are made."""
    n = max(1, -(-df.count() // rows) if parts is None else parts)
    plain = df.select(*[c for c in df.columns if not c.startswith("__segment_")])
    keys = [*by, *(order if cut is None else cut)]
    if weight is None:
        cuts = plain.repartitionByRange(n, *keys)
    else:
        # further rows of the same keys, without the other columns, that end behind the cuts
        nth = plain.withColumn("__nth", F.explode(F.sequence(F.lit(1), weight.cast("int"))))
        nth = nth.select("__nth", *(F.col(c) if c in keys else F.when(F.col("__nth") == 1, F.col(c)).alias(c) for c in plain.columns))
        # a condition that the optimizer leaves behind the cuts
        cuts = nth.repartitionByRange(n, *keys).where(F.when(F.spark_partition_id() >= 0, F.col("__nth")) == 1).drop("__nth")
    return written(cuts.withColumn(segment_column(order), F.spark_partition_id()), "segments")


def deal_if_large(df: DataFrame, by: list[str], order: list[str], rows: int = 1_000_000) -> DataFrame:
    """Dealt if some stream has more than ``rows`` rows, else ``df`` itself: many small streams are many tasks already."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return deal(df, by, order, rows) if most > rows else df


@dataclass(frozen=True)
class Running:
    """A running value: the window expression, a segment's summary, how summaries are carried, and how both are put together.

    ``local`` gets the ordered window without a frame and its keys, ``carry`` the summaries' column and the windows over a
    stream's earlier and later segments (rows nearest last) and over all of them."""

    local: Callable[[WindowSpec, WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec, WindowSpec, WindowSpec], Column]
    both: Callable[[Column, Column], Column]
    plain: Callable[[Column], Column] = lambda c: c


def total(value: Column, frame: tuple[int, int] = _UPTO) -> Running:
    """Sum up to and with this row."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Running(lambda w, _: F.sum(value).over(w.rowsBetween(*frame)), lambda _: F.sum(value), lambda c, before, after, all_: F.sum(c).over(before), lambda a, b: zero(a) + zero(b), zero)


def total_before(value: Column) -> Running:
    """Sum of the rows before this one."""
    return total(value, _BEFORE)


def most(value: Column) -> Running:
    """Maximum up to and with this row."""
    return Running(lambda w, _: F.max(value).over(w.rowsBetween(*_UPTO)), lambda _: F.max(value), lambda c, before, after, all_: F.max(c).over(before), F.greatest)


def last(value: Column) -> Running:
    """Last non-null value up to and with this row."""
    return Running(
        lambda w, _: F.last(value, ignorenulls=True).over(w.rowsBetween(*_UPTO)),
        lambda place: F.max_by(value, F.when(value.isNotNull(), place)),
        lambda c, before, after, all_: F.last(c, ignorenulls=True).over(before),
        F.coalesce,
    )


def previous(value: Column) -> Running:
    """Value of the row before, null or not."""
    held = F.struct(value.alias("v"))
    return Running(lambda w, _: F.lag(held).over(w), lambda place: F.max_by(held, place), lambda c, before, after, all_: F.last(c, ignorenulls=True).over(before), lambda a, b: F.coalesce(a, b)["v"], lambda c: c["v"])


def following(value: Column) -> Running:
    """Value of the row after, null or not."""
    held = F.struct(value.alias("v"))
    return Running(lambda w, _: F.lead(held).over(w), lambda place: F.min_by(held, place), lambda c, before, after, all_: F.last(c, ignorenulls=True).over(after), lambda a, b: F.coalesce(a, b)["v"], lambda c: c["v"])


def whole(value: Column, agg: Callable[[Column], Column]) -> Running:
    """``agg`` (min, max or sum) of all rows of the stream."""
    return Running(lambda _, keys: agg(value).over(keys), lambda _: agg(value), lambda c, before, after, all_: agg(c).over(all_), lambda a, b: b)


def ahead(value: Column, rows: int) -> Running:
    """Values of this row and of those after it, ``rows`` in all, fewer at the end; nulls as they are."""
    held = F.struct(value.alias("v"))
    values = lambda c: F.transform(c, lambda x: x["v"])
    nth = F.col(_NTH)
    first_rows = F.array_sort(F.collect_list(F.when(nth < rows, F.struct(nth.alias("n"), value.alias("v")))))
    return Running(
        lambda w, _: F.collect_list(held).over(w.rowsBetween(0, rows - 1)),
        lambda _: F.transform(first_rows, lambda x: F.struct(x["v"].alias("v"))),
        # every segment of a stream has a row at least, so the next ones of that number suffice
        lambda c, before, after, all_: F.flatten(F.reverse(F.collect_list(c).over(after.rowsBetween(1 - rows, -1)))),
        lambda a, b: values(F.slice(F.concat(a, F.coalesce(b, F.slice(a, F.lit(1), F.lit(0)))), F.lit(1), F.lit(rows))),
        values,
    )


def run(df: DataFrame, by: list[str], order: list[str], **specs: Running) -> DataFrame:
    """``df`` with a column for each of ``specs``, running within ``by`` in ``order``."""
    seg = segment_of(df, order)
    inside = [*by, seg] if seg else by
    w, keys = Window.partitionBy(*inside).orderBy(*order), Window.partitionBy(*inside)
    if not seg:
        return df.withColumns({k: s.plain(s.local(w, keys)) for k, s in specs.items()})
    place = F.struct(*order)
    df = df.withColumn(_NTH, F.row_number().over(w))
    sums = df.groupBy(*inside).agg(*(s.summary(place).alias(f"__s_{k}") for k, s in specs.items()))
    stream = Window.partitionBy(*by)
    before, after = stream.orderBy(F.col(seg)).rowsBetween(*_BEFORE), stream.orderBy(F.col(seg).desc()).rowsBetween(*_BEFORE)
    carried = sums.select(*(F.col(c).alias(f"__k_{i}") for i, c in enumerate(inside)), *(s.carry(F.col(f"__s_{k}"), before, after, stream).alias(f"__c_{k}") for k, s in specs.items()))
    local = df.withColumns({k: s.local(w, keys) for k, s in specs.items()})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k_{i}")) for i, c in enumerate(inside)))
    out = local.join(carried, same, "left").withColumns({k: s.both(F.col(k), F.col(f"__c_{k}")) for k, s in specs.items()})
    return out.drop(_NTH, *(c for c in out.columns if c.startswith(("__k_", "__c_"))))
