"""Mixing sources to target weights by Pareto order sampling.

A source's target is ``share`` of all words, dealt by weight, at most ``most`` times its own words; what is above goes to the
other sources by weight until none is above. Sorted by words per weight the full sources come first, so running sums
give this in closed form. Every document gets floor(target / words) certain whole copies. The rest of the target is met by a
sample without replacement whose inclusion probabilities grow with the documents' sizes: p = min(1, scale · size), the
scale such that the expected words equal the rest. Documents are ranked by Pareto keys, the odds of a uniform number
divided by the inclusion odds, and enter from the least key on, up to the document whose entry would bring the words farther
from the target. A source so misses its target by at most half the words of the document at the cut.

The uniform number is a digest of doc_id and text, so reruns agree and no input order or partitioning shows. Ranks need
no task with a whole source: rows go to range partitions by (source, key), and each partition's sums give the next one's
start. Texts are read once; sizes and digests go on.

Defined cases: a null text has size 0; documents of size 0 are never taken; rows equal in doc_id and text are
interchangeable (so many of them enter, whichever); null sources are one source, the last; no words, no targets (0); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_enough

WORD = r"[^\x20\x09-\x0D]+"
WHOLE = "decimal(38,0)"


def running(df: DataFrame, groups: list[str], order: list, sums: dict[str, str], rows_per_partition: int = 200_000) -> DataFrame:
    """``df`` with ``sums`` (new column: summed column) running within ``groups`` by ``order``, each row included.

    Rows go to range partitions by groups and order; windows run inside a partition, and start from the sums of the partitions
    before. ``df`` must be stable under recomputation. A key whose rows are all equal stays together, so end ``order`` with a salt.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_partition))
    dealt = materialize(df.repartitionByRange(n, *groups, *order).withColumn("__part", F.spark_partition_id()), "running")
    parts = dealt.groupBy(*groups, "__part").agg(*[F.sum(F.col(c).cast(WHOLE)).alias(o) for o, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*groups, "__part", *[F.coalesce(F.sum(o).over(before), F.lit(0)).cast(WHOLE).alias(f"__{o}") for o in sums])
    inside = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(F.col(c).cast(WHOLE)).over(inside).cast(WHOLE).alias(o) for o, c in sums.items()])
    whole = local.join(starts, [*groups, "__part"])
    return whole.withColumns({o: (F.col(o) + F.col(f"__{o}")).cast(WHOLE) for o in sums}).drop("__part", *[f"__{o}" for o in sums])


def targets(sources: DataFrame, weights: list[int], share_pct: int, most: int) -> DataFrame:
    """``sources`` (source, source_size) with target: by code point of the source, null last, ``weights`` repeat."""
    one = sources.withColumn("one", F.lit(1))
    ranked = running(one, [], [F.col("source").asc_nulls_last()], {"nth": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "mix-weights")
    total = ranked.agg(F.sum(F.col("source_size").cast(WHOLE)).alias("words"), F.sum("weight").alias("weights"))
    # by words per weight: while a source and all before it are full, the rest is dealt over the weights from it on
    per = F.col("source_size") / F.col("weight")
    sums = running(ranked.withColumn("per", per), [], ["per", F.col("source").asc_nulls_last()], {"upto": "source_size", "weights_upto": "weight"})
    joined = sums.crossJoin(F.broadcast(total))  # one row
    left = F.col("words") * (share_pct / 100) - most * (F.col("upto") - F.col("source_size"))
    fair = left.cast("double") / (F.col("weights") - F.col("weights_upto") + F.col("weight")).cast("double")
    marked = joined.select("source", "source_size", "weight", fair.alias("fair"), (fair * F.col("weight") > most * F.col("source_size")).alias("full"))
    # the first source that is not full sets the level of all that follow
    level = marked.where("NOT full").agg(F.min_by("fair", F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))).alias("level"))
    target = F.when(F.col("full") | F.col("level").isNull(), (most * F.col("source_size")).cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double")))
    return marked.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def scales(sizes: DataFrame, rest: DataFrame) -> DataFrame:
    """(of, scale) per source with sum of min(1, scale · size) · size = rest, from counts of sizes (source, size, n).

    A source's distinct sizes number at most sqrt(2 · words). The largest are certain while scale · size > 1.
    """
    rest = rest.withColumnRenamed("source", "of")
    j = sizes.where("size > 0").join(rest, F.col("source").eqNullSafe(F.col("of"))).select("of", "size", "n", "rest")
    down = Window.partitionBy("of").orderBy(F.col("size").desc())
    certain = F.coalesce(F.sum(F.col("size").cast(WHOLE) * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum((F.col("size").cast(WHOLE) * F.col("size") * F.col("n")).cast(WHOLE)).over(down.rowsBetween(0, Window.unboundedFollowing))
    scale = (F.col("rest") - certain.cast("double")) / squares.cast("double")
    tried = j.select("of", "size", scale.alias("scale"))
    return tried.where(F.col("scale") * F.col("size") <= 1).groupBy("of").agg(F.max_by("scale", "size").alias("scale"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_pct: int = 150, most: int = 2, seed: int = 42, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (doc_id, source, text)."""
    text = F.coalesce("text", F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 13), 16, 10)
    light = materialize(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), ((draw.cast("double") + 0.5) / float(1 << 52)).alias("u"), F.monotonically_increasing_id().alias("salt")), "mix-sizes")
    sizes = materialize(light.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = materialize(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size")), "mix-sources")
    goal = targets(sources, list(weights), share_pct, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = materialize(goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    scale = scales(sizes, goal.where("rest > 0").select("source", "rest"))
    plan = materialize(goal.join(scale, F.col("source").eqNullSafe(F.col("of")), "left").select(F.monotonically_increasing_id().alias("src"), F.col("source").alias("of"), "source_size", "target", "copies", "rest", "scale"), "mix-plan")
    same = F.col("source").eqNullSafe(F.col("of"))
    if small_enough(plan, broadcast_rows):
        j = light.join(F.broadcast(plan), same)
    else:  # a source can hold a third of all rows: its rows are spread over 64 copies of its plan
        spread = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
        j = light.join(spread, same & (F.pmod(F.xxhash64("salt"), F.lit(64)) == F.col("part")))
    p = F.least(F.lit(1.0), F.col("scale") * F.col("size"))
    key = F.when(F.col("scale").isNull() | (F.col("size") == 0), F.lit(float("inf"))).otherwise((F.col("u") / (1 - F.col("u"))) * ((1 - p) / p))
    ranked = running(j.select("doc_id", "src", "size", "source_size", "target", "copies", "rest", key.alias("key"), "u", "salt"), ["src"], ["key", "u", "salt"], {"upto": "size"})
    enters = (2 * F.col("upto") - F.col("size")).cast("double") <= 2 * F.col("rest")
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.when(enters, 1).otherwise(0))).cast("bigint").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 and so on; 150 % of all words; no document more than twice."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT source, z, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
r AS (SELECT source, z, w, CAST(z AS DOUBLE) / w AS per,
    (CAST((SELECT sum(z) FROM w) AS DOUBLE) * 1.5 - 2 * CAST(coalesce(sum(z) OVER (ORDER BY CAST(z AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY CAST(z AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fair FROM w),
l AS (SELECT first(fair ORDER BY per, source NULLS LAST) AS level FROM r WHERE NOT fair * w > 2 * z),
t AS (SELECT source, z, CASE WHEN fair * w > 2 * z OR level IS NULL THEN CAST(2 * z AS DOUBLE) ELSE least(level * w, CAST(2 * z AS DOUBLE)) END AS target FROM r, l),
g AS (SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS copies FROM t),
h AS (SELECT *, target - copies * z AS rest FROM g),
n AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
c AS (SELECT n.source, n.size, (h.rest - CAST(coalesce(sum(n.size * n.n) OVER (PARTITION BY n.source ORDER BY n.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(n.size * n.size * n.n) OVER (PARTITION BY n.source ORDER BY n.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS scale
    FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE h.rest > 0),
k AS (SELECT source, arg_max(scale, size) AS scale FROM c WHERE scale * size <= 1 GROUP BY source),
q AS (SELECT d.doc_id, d.size, h.source, h.z, h.target, h.copies, h.rest, d.u,
    CASE WHEN k.scale IS NULL OR d.size = 0 THEN CAST('inf' AS DOUBLE) ELSE (d.u / (1 - d.u)) * ((1 - least(1.0, k.scale * d.size)) / least(1.0, k.scale * d.size)) END AS key
    FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, z AS source_size, target, CAST(size * (copies + CASE WHEN CAST(2 * upto - size AS DOUBLE) <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
