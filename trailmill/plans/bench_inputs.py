"""Input of the classification benchmark: a synthetic vocabulary and records that cycle through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import Entry, classify


def entries(n: int = 1000) -> list[Entry]:
    return [
        Entry(id=f"e{i:04d}", platform="android", cls=f"Site{i % 50}", method="run", level="INFO", patterns=[rf"probe point {i:04d} reached: code=(\d+) state=(\w+)"])
        for i in range(n)
    ]


def synthetic_records(spark: SparkSession, n: int, size: int = 1000) -> DataFrame:
    i = F.col("id")
    site = F.lpad((i % size).cast("string"), 4, "0")
    raw = F.concat(F.lit("01-02 03:04:05.678 INFO [Site"), (i % size % 50).cast("string"), F.lit(" run] \n  probe point "), site, F.lit(" reached: code="), i.cast("string"), F.lit(" state=ok"))
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("android").alias("platform"), raw.alias("raw"), F.concat(F.lit("Site"), (i % size % 50).cast("string")).alias("tag_class"), F.lit("run").alias("tag_method"),
        F.lit("INFO").alias("level"), F.lit(None).cast("string").alias("icon"), F.lit(None).cast("string").alias("version"),
    )


def classified(records: DataFrame, size: int = 1000) -> DataFrame:
    return classify(records, entries(size))
