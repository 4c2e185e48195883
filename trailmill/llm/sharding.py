"""Sharding by best-fit-decreasing bin packing.

Rows of equal texts form a group that is never split. Groups enter by falling total size the bin with the tightest
remaining capacity that still holds them; remaining capacities live in a balanced tree. Groups of one size are alike,
so the packing runs on sizes and their counts: a run of equal groups fills the tightest bin as far as it goes, which is
what placing them one by one does. The driver sees one row per distinct group size; distinct sizes that add up to at
most B bytes number at most sqrt(2 B), 245 thousand at 30 GB.

For a given number of shards, groups too large for an even share get a shard of their own; for the rest the smallest
capacity that fits is searched. ``pack`` itself minimises the number of bins for a fixed capacity.

Groups of one size are then dealt to their bins by a gapless rank, and rows get gapless slots, both by counts per hash
bucket: no task holds a whole shard or size.

Defined cases: a null text is an empty one (size 1); equal rows are in one group; fewer groups than shards leave shards
empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, materialize


class CapacityTree:
    """Balanced tree of (remaining, bin), two levels with leaves that split; finds the least remaining for a size."""

    def __init__(self):
        self.items: list[list[tuple[int, int]]] = [[]]
        self.heads: list[tuple[int, int]] = []

    LEAF = 512

    def _leaf(self, key):
        return max(0, bisect_left(self.heads, (key[0], key[1] + 1)) - 1) if self.heads else 0

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        i = self._leaf(key)
        leaf = self.items[i]
        insort(leaf, key)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.items[i : i + 1] = [leaf[:half], leaf[half:]]
            self.heads[i : i + 1] = [leaf[0], leaf[half]]
        elif i < len(self.heads):
            self.heads[i] = leaf[0]
        else:
            self.heads.append(leaf[0])

    def pop_fit(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (remaining, bin) that holds ``size``."""
        if not self.heads:
            return None
        i = max(0, bisect_left(self.heads, (size, -1)) - 1)
        k = bisect_left(self.items[i], (size, -1))
        if k == len(self.items[i]):
            i, k = i + 1, 0
            if i == len(self.items):
                return None
        got = self.items[i].pop(k)
        if self.items[i]:
            self.heads[i] = self.items[i][0]
        else:
            del self.items[i], self.heads[i]
            if not self.items:
                self.items = [[]]
        return got


def pack(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit-decreasing for (size, count) pairs: (size, bin, count) in the order of placing. Opens bins as needed;
    None if more than ``bins`` would be needed, or a size exceeds the capacity."""
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        while count:
            fit = tree.pop_fit(size)
            if fit is None:
                if bins is not None and opened == bins:
                    return None
                fit = (capacity, opened)
                opened += 1
            n = min(count, fit[0] // size)
            out.append((size, fit[1], n))
            count -= n
            if fit[0] - n * size:
                tree.add(fit[0] - n * size, fit[1])
    return out


def pack_even(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, count): sizes packed in ``shards`` bins of nearly equal fill."""
    rest = sorted(((s, c) for s, c in sizes if c > 0), reverse=True)
    out, first = [], 0
    total = sum(s * c for s, c in rest)
    # what exceeds an even share of what is left stands alone
    while rest and first < shards - 1 and rest[0][0] * (shards - first) > total:
        s, c = rest[0]
        out.append((s, first, 1))
        first += 1
        total -= s
        rest[0] = (s, c - 1)
        if c == 1:
            rest.pop(0)
    if not rest:
        return out
    n = shards - first
    low = max(-(-total // n), rest[0][0])
    step, high, best = 0, low, None
    while best is None:
        high = low + step
        best = pack(rest, high, n)
        step = max(1, step * 2)
    low_bad = low + step // 4 if step > 2 else low - 1
    while high - low_bad > 1:
        mid = (high + low_bad) // 2
        got = pack(rest, mid, n)
        if got is None:
            low_bad = mid
        else:
            high, best = mid, got
    return out + [(s, b + first, c) for s, b, c in best]


def shard_by_size(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): shards of nearly equal bytes, groups whole."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("b"), text).alias("h2"),
    )
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("h1", "h2", "size").agg(F.count("*").alias("n")).select("h1", "h2", (F.col("size") * F.col("n")).alias("total")), "groups")
    sizes = [(r[0], r[1]) for r in groups.groupBy("total").count().collect()]
    placed = pack_even(sizes, shards)
    # ranks of a size's groups, cut into ranges per bin
    ranges, used = [], {}
    for size, shard, n in placed:
        a = used.get(size, 0)
        ranges.append((size, a, a + n, shard))
        used[size] = a + n
    whole = [(s, b) for s, a, z, b in ranges if a == 0 and z == used[s]]
    parts = [r for r in ranges if not (r[1] == 0 and r[2] == used[r[0]])]
    whole_df = spark.createDataFrame(whole, "total bigint, shard int")
    parts_df = spark.createDataFrame(parts, "total bigint, a bigint, z bigint, shard int")
    # only sizes that are spread over several bins need ranks; there are at most as many ranges as sizes and bins
    split = groups.join(parts_df.select("total").distinct(), "total", "left_semi")
    ranked = gapless(split, ["total"], ["h1", "h2"], "rank").join(parts_df, "total").where("rank >= a and rank < z")
    of = groups.join(whole_df, "total").select("h1", "h2", "shard").union(ranked.select("h1", "h2", "shard"))
    sharded = materialize(rows.join(of, ["h1", "h2"]).select("id", "size", "crc", "shard"), "sharded")
    out = gapless(sharded, ["shard"], ["id", "crc"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir):
    return shard_by_size(spark.read.parquet(f"{sf_dir}/documents.parquet"))
