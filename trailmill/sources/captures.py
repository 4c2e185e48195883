"""Captures: log files, compressed or not, as rows (capture_id, path, platform, kind, text, year, notes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan
from ..operators.shared import written

#: Line ends of Unicode text: CR LF, or one of the characters that end a line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Fixed grammars of record headers.
ANDROID_HEADER = r"^(\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}\.\d{3}) (DEBUG|INFO|WARN|ERROR) \[(\S+) ((?:[^\[\]]|\[[^\]]*\])*)\] ?(.*)$"
IOS_HEADER = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}\.\d{3})(?: (.*))?$"
#: Tables that tell a log database's platform.
TABLES = {"logging_event": "android", "logs": "ios"}
SNIFF_LINES = 200

_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("db_platform", T.StringType()), T.StructField("text", T.StringType())])


def _decode(frames):
    """Bytes to text: gzip by suffix or magic, UTF-8 with replacement; a SQLite container is recognised, not read."""
    import gzip

    import pandas as pd

    for f in frames:
        rows = []
        for path, when, data in zip(f["path"], f["modificationTime"], f["content"]):
            data = bytes(data)
            if path.endswith(".gz") or data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            if data[:16] == b"SQLite format 3\x00":
                rows.append((path, when.year, "db", _db_platform(data), None))
            else:
                rows.append((path, when.year, "text", None, data.decode("utf-8", "replace")))
        yield pd.DataFrame(rows, columns=["path", "year", "kind", "db_platform", "text"])


def _db_platform(data: bytes) -> str:
    import sqlite3

    try:
        c = sqlite3.connect(":memory:")
        c.deserialize(data)
        names = {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    except sqlite3.Error:
        return "unknown"
    return next((p for t, p in TABLES.items() if t in names), "unknown")


def read_captures(spark: SparkSession, paths: list[str], year: int | None = None) -> DataFrame:
    """One row per file; ``paths`` can be globs. Files are read by Spark, so any store that it reads will do.

    ``capture_id`` is the file's stem; where several files have one stem, a hash of the path follows it, so that no two
    files are one capture."""
    raw = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "content")
    d = raw.mapInPandas(_decode, _SCHEMA)
    if year is not None:
        d = d.withColumn("year", F.lit(year))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.[^.]+$", ""), " ", "_")
    # paths only, which the driver has listed already; contents stay where they are
    shared = raw.select("path").distinct().groupBy(stem.alias("stem")).agg(F.count("*").alias("files")).where("files > 1")
    d = d.withColumn("stem", stem).join(F.broadcast(shared), "stem", "left")
    tagged = F.concat_ws("-", "stem", F.substring(F.sha2("path", 256), 1, 8))
    d = d.withColumn("capture_id", F.when(F.col("files").isNull(), F.col("stem")).otherwise(tagged)).drop("stem", "files")
    d = with_platform(d)
    note = F.when(F.col("platform") == "unknown", F.array(F.lit("unrecognized log format"))).otherwise(F.array().cast("array<string>"))
    return d.withColumn("notes", note)


def largest_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Size of the largest file, from the listing: no content is read."""
    return spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0


def total_bytes(spark: SparkSession, paths: list[str]) -> int:
    return spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0


def text_lines(text: Column) -> Column:
    """Array of lines; an end of line at the end of the text adds none."""
    lines = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: line_no from 1, and line."""
    keep = [c for c in df.columns if c != text]
    # the split is a column of its own, so that it runs once
    d = df.select(*keep, F.when(F.col(text) != "", F.split(F.col(text), LINE_END, -1)).alias("__l"))
    lines = F.when(F.element_at("__l", -1) == "", F.slice("__l", F.lit(1), F.size("__l") - 1)).otherwise(F.col("__l"))
    return d.select(*keep, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def with_platform(df: DataFrame, text: str = "text") -> DataFrame:
    """Add platform: of the first non-blank lines the first that has a header decides; after SNIFF_LINES others the
    format counts as unknown. Works inside each row: nothing is shuffled."""
    lines = F.slice(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END, -1), lambda x: F.trim(x) != ""), 1, SNIFF_LINES + 1)
    kinds = F.filter(F.transform(lines, lambda x: F.when(x.rlike(ANDROID_HEADER), "android").when(x.rlike(IOS_HEADER), "ios")), lambda k: k.isNotNull())
    sniffed = F.coalesce(F.get(kinds, F.lit(0)), F.lit("unknown"))
    return df.withColumn("platform", F.coalesce("db_platform", sniffed) if "db_platform" in df.columns else sniffed)


def duplicates(df: DataFrame, key: str, text: str, place_chars: int = 64, segment_bytes: int = 32 << 20, row_bytes: int = 2048, common: int = 100_000) -> DataFrame:
    """(key, duplicate): a text is a duplicate if an earlier row (by ``key``) is equal, or another text continues it.

    A ladder: each different text has the hashes of its beginnings of 1, 2, 4, 8 … characters, and can only be continued by
    texts that share the longest of its own. Texts of a rung that some text ends on are sorted; one that others continue is
    followed by such a one, which is looked at character by character. A text that ends on a rung is shorter than the next,
    so texts meet there by their beginnings of that length. The sort is cut by rung, hash and the characters behind the
    beginning, so that a beginning which many texts share is not one task, in segments of about ``segment_bytes``; a row counts as ``row_bytes`` at least.
    Beginnings of more than ``common`` texts, which are few, go to all tasks. The empty text is the beginning of every other."""
    d = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.sha2("t", 256))
    distinct = d.groupBy("h").agg(F.min("k").alias("k"), F.first("t").alias("t"))
    distinct = written(distinct.withColumn("n", F.length("t")), "texts")
    rungs = F.transform(F.sequence(F.lit(0), F.floor(F.log2("n")).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    ladder = distinct.where("n > 0").select("h", "n", "t", F.explode(rungs).alias("p"))
    ladder = written(ladder.select("h", "p", F.xxhash64(F.expr("left(t, p)")).alias("b"), (F.col("n") < 2 * F.col("p")).alias("ends")), "beginnings")
    groups = written(ladder.groupBy("p", "b").agg(F.count("*").alias("m"), F.max("ends").alias("any_ends")), "groups")
    most = F.broadcast(groups.where(F.col("m") > common).select("p", "b", "any_ends"))
    few = groups.where(F.col("any_ends") & F.col("m").between(2, common)).select("p", "b")
    ladder = ladder.select("h", "p", "b")
    meet = ladder.join(most.where("any_ends").select("p", "b"), ["p", "b"]).union(ladder.join(most, ["p", "b"], "left_anti").join(few, ["p", "b"]).select("p", "b", "h"))
    meet = meet.select("h", "p", "b").join(distinct.select("h", "t"), "h")
    behind = lambda i: F.substring(F.col("t"), F.col("p") + 1 + i * place_chars, F.lit(place_chars))
    meet = written(meet.select("h", "p", "b", F.expr("left(t, 2 * p)").alias("t"), (F.length("t") < 2 * F.col("p")).alias("ends")), "meetings")
    weight = F.ceil((F.octet_length("t") + 1) / F.lit(row_bytes))
    parts = -(-(meet.agg(F.sum(weight)).first()[0] or 0) * row_bytes // segment_bytes)
    meet = meet.select("h", "p", "b", behind(0).alias("s0"), behind(1).alias("s1"), "t", "ends")
    order = ["s0", "s1", "t"]
    meet = scan.run(scan.deal(meet, ["p", "b"], order, cut=["s0", "s1"], parts=parts, weight=weight), ["p", "b"], order, after=scan.following(F.col("t")))
    cont = meet.where(F.col("ends") & F.col("after").startswith(F.col("t"))).select("h").distinct()
    some = distinct.where("n > 0").limit(1).select(F.lit("").alias("t"))
    cont = cont.union(distinct.where("n = 0").join(some, "t", "left_semi").select("h"))
    d = d.select("k", "h").join(distinct.select("h", F.col("k").alias("first")), "h").join(cont.withColumn("cont", F.lit(True)), "h", "left")
    return d.select(F.col("k").alias(key), (F.coalesce("cont", F.lit(False)) | (F.col("k") != F.col("first"))).alias("duplicate"))
