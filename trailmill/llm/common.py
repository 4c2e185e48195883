"""Shared helpers: tables in the shared folder, gapless numbering and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; an own temporary one
    only where it is unset and everything runs in one process; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="trailmill-")
        atexit.register(_drop, _OWN[key])
    return "file://" + _OWN[key]


def _drop(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) with component the smallest node reachable, for ``edges`` (a, b) of bigints.

    Alternating large-star and small-star rounds; each round is two aggregations and two joins over the edges,
    written to the shared folder. Nothing is collected but a row count and a checksum per round.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "cc")
    sign = _checksum(e)
    for _ in range(max_rounds):
        if sign[0] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = materialize(small, "cc")
        again = _checksum(nxt)
        e = nxt
        if again == sign:
            break
        sign = again
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _checksum(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def gapless(df: DataFrame, groups: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: 0, 1, 2 … within each value of ``groups``, without one task that holds a whole group.

    Rows are dealt to buckets by a hash of ``order``; counts per (group, bucket) give each bucket's offset and a
    window inside the bucket gives the rest. ``order`` should be nearly unique, else equal values share a bucket.
    The table must be stable under recomputation (read from files).
    """
    n = df.count()
    buckets = max(16, min(1 << 20, -(-n // rows_per_bucket)))
    keyed = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*groups, "__b").orderBy(*order)
    ranked = keyed.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*groups, "__b"]).withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint")).drop("__b", "__r", "__off")


def grouped(batches, col: int = 0):
    """From record batches sorted by a bigint column: (batch, starts, ends) with whole groups of equal values only."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = t.column(col).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] else 0
        if cut:
            edge = np.flatnonzero(np.diff(key[:cut])) + 1
            yield t.slice(0, cut), np.concatenate([[0], edge]), np.concatenate([edge, [cut]])
        held = t.slice(cut)
    if held is not None:
        yield held, np.array([0]), np.array([held.num_rows])
