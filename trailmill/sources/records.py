"""Record assembly: lines of a capture to records, for both header grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EMOJI, none_if_empty, strip_variation
from ..operators import scan
from ..operators.sequence import year_offset
from .captures import ANDROID_HEADER, IOS_HEADER, explode_lines

_PSEUDO = "^[⏱⏰]️?\\s*\\[(\\S+) ([^\\]]+)\\]\\s*(.*)$"
_ICON = f"{EMOJI}[\\x{{FE0E}}\\x{{FE0F}}\\x{{1F3FB}}-\\x{{1F3FF}}]*(?:\\x{{200D}}{EMOJI}[\\x{{FE0E}}\\x{{FE0F}}]*)*"
_SLOT = f"(?s)^\\s*((?!\\x{{1F4CD}}<){_ICON})?\\s*((?!\\x{{1F4CD}}<){_ICON})?\\s*(?:(?:__\\d+)?[+-]\\[(\\w+) ([^\\]]+)\\](?:_block_invoke(?:_?\\d+)?)?\\s*)?(.*)$"

COLUMNS = ["capture_id", "platform", "seq", "line_no", "ts", "ts_raw", "level", "icon", "tag_class", "tag_method_raw", "tag_method", "header_msg", "body", "raw"]


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _fold(lines: DataFrame, header: str) -> DataFrame:
    """One row per record: capture columns, line_no, head, body (array). Lines before the first header go. ``lines`` can be
    dealt in segments by line_no; records then are grouped by capture and number, which no large capture makes one task."""
    by = ["capture_id"]
    d = scan.run(lines.withColumn("__h", F.col("line").rlike(header)), by, ["line_no"], rec=scan.total(F.col("__h").cast("int"))).where("rec > 0")
    more = F.array_sort(F.collect_list(F.when(~F.col("__h"), F.struct("line_no", "line"))))
    keep = [c for c in lines.columns if c not in (*by, "line_no", "line", scan.segment_column(["line_no"]))]
    g = d.groupBy(*by, "rec").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("head"), more.alias("__m"), *(F.first(c).alias(c) for c in keep))
    return g.withColumn("body", F.col("__m")["line"]).withColumn("seq", F.col("rec") - 1).drop("__m", "rec")


def _numbered(lines: DataFrame, header: str) -> DataFrame:
    """Records of ``lines``; dealt by seq where the lines are dealt by line_no."""
    d = _fold(lines, header)
    return scan.deal(d, ["capture_id"], ["seq"]) if scan.segment_of(lines, ["line_no"]) else d


def _columns(d: DataFrame) -> list[str]:
    seg = scan.segment_of(d, ["seq"])
    return [*COLUMNS, seg] if seg else COLUMNS


def _raw(head: Column, body: Column) -> Column:
    return F.when(F.size(body) > 0, F.concat(head, F.lit("\n"), F.concat_ws("\n", body))).otherwise(head)


def _ts(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz")


def android_records(lines: DataFrame) -> DataFrame:
    """``lines``: capture_id, year, line_no, line (and platform)."""
    d = _numbered(lines, ANDROID_HEADER)
    h = F.col("head")
    d = d.withColumn("month", _part(h, ANDROID_HEADER, 1).substr(1, 2).cast("int"))
    d = year_offset(d, "month", ["capture_id"], ["seq"])
    d = d.withColumn("ts_raw", F.concat_ws(" ", _part(h, ANDROID_HEADER, 1), _part(h, ANDROID_HEADER, 2)))
    d = d.withColumn("ts", _ts(F.concat_ws("-", (F.col("year") + F.col("years")).cast("int").cast("string"), F.col("ts_raw"))))
    msg, klass, method = _part(h, ANDROID_HEADER, 6), _part(h, ANDROID_HEADER, 4), _part(h, ANDROID_HEADER, 5)
    pseudo = msg.rlike(_PSEUDO)
    d = d.withColumn("__msg", F.when(pseudo, _part(msg, _PSEUDO, 3)).otherwise(msg))
    d = d.withColumn("tag_class", F.when(pseudo, _part(msg, _PSEUDO, 1)).otherwise(klass))
    d = d.withColumn("tag_method_raw", F.when(pseudo, _part(msg, _PSEUDO, 2)).otherwise(method))
    d = d.withColumn("tag_method", F.regexp_replace("tag_method_raw", "(\\[λ\\]|\\$\\d+)$", ""))
    first = F.regexp_extract(F.ltrim(F.coalesce(F.get("body", F.lit(0)), F.lit(""))), f"^{_ICON}", 0)
    icon = F.coalesce(none_if_empty(first), none_if_empty(F.regexp_extract(F.ltrim(msg), f"^{_ICON}", 0)))
    d = d.withColumn("icon", strip_variation(icon)).withColumn("level", _part(h, ANDROID_HEADER, 3))
    return d.withColumn("header_msg", F.col("__msg")).withColumn("raw", _raw(h, F.col("body"))).withColumn("platform", F.lit("android")).select(*_columns(d))


def ios_records(lines: DataFrame) -> DataFrame:
    d = _numbered(lines, IOS_HEADER)
    h = F.col("head")
    # blank lines at the end separate records; those inside stay
    last = F.array_max(F.transform("body", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    d = d.withColumn("body", F.slice("body", F.lit(1), F.coalesce(last, F.lit(0)).cast("int")))
    d = d.withColumn("ts_raw", F.concat_ws(" ", _part(h, IOS_HEADER, 1), _part(h, IOS_HEADER, 2))).withColumn("ts", _ts(F.col("ts_raw")))
    rest = _part(h, IOS_HEADER, 3)
    d = d.withColumn("icon", none_if_empty(strip_variation(F.concat(_part(rest, _SLOT, 1), _part(rest, _SLOT, 2)))))
    d = d.withColumn("tag_class", none_if_empty(_part(rest, _SLOT, 3))).withColumn("tag_method_raw", none_if_empty(_part(rest, _SLOT, 4)))
    d = d.withColumn("tag_method", F.col("tag_method_raw")).withColumn("header_msg", _part(rest, _SLOT, 5)).withColumn("level", F.lit(None).cast("string"))
    return d.withColumn("raw", _raw(h, F.col("body"))).withColumn("platform", F.lit("ios")).select(*_columns(d))


def assemble(captures: DataFrame, large: bool = False) -> DataFrame:
    """Records of all captures (capture_id, platform, year, text) at once. ``large``: lines and records are dealt in
    segments, so that no task holds a capture."""
    some = captures.where(F.col("text").isNotNull()).select("capture_id", "platform", "year", "text")
    deal = lambda d: scan.deal(d, ["capture_id"], ["line_no"]) if large else d
    a = android_records(deal(explode_lines(some.where("platform = 'android'"))))
    i = ios_records(deal(explode_lines(some.where("platform = 'ios'"))))
    return a.unionByName(i)
