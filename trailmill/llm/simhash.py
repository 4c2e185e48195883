"""SimHash near-dedup with BK-trees.

Texts get a 64-bit fingerprint from the hashes of their word shingles. Fingerprints that differ in at most
``radius`` bits are linked. Distinct fingerprints are dealt to shards by the values of block pairs: 64 bits in
``radius + 2`` blocks, so two fingerprints within the radius agree on at least two blocks and meet in a shard. A
shard holds a BK-tree (children keyed by their integer Hamming distance to the parent); a search follows only the
edges within the radius of the distance at the node. A shard gives a spanning forest of its links, never all pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other; equal
rows share a fingerprint and a component; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        h = np.array([digest(b" ".join(w), seed)], dtype=np.uint64)
    else:
        grams = zip(*(w[i:] for i in range(words)))
        h = np.fromiter((digest(g, seed) for g in map(b" ".join, grams)), dtype=np.uint64, count=len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65536):
        part = h[a : a + 65536]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp bigint): one row per row of ``docs``."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


class BKTree:
    """BK-tree over distinct 64-bit values; searches run for many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        n = len(values)
        self.child = np.full((n, 65), -1, dtype=np.int32)
        ints = [int(v) for v in self.values]
        kids: list[dict[int, int]] = [{} for _ in range(n)]
        for i in range(1, n):
            at, v = 0, ints[i]
            while True:
                d = (v ^ ints[at]).bit_count()
                nxt = kids[at].get(d)
                if nxt is None:
                    kids[at][d] = i
                    self.child[at, d] = i
                    break
                at = nxt

    def pairs(self, radius: int, block: int = 256):
        """Yield (i, j) index arrays of values within the radius, i < j, in blocks of queries."""
        n = len(self.values)
        for lo in range(0, n, block):
            q = np.arange(lo, min(n, lo + block))
            node = np.zeros(len(q), dtype=np.int64)
            while len(q):
                d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
                hit = (d <= radius) & (q < node)
                if hit.any():
                    yield q[hit], node[hit]
                nq, nn = [], []
                for step in range(-radius, radius + 1):
                    e = d + step
                    ok = (e >= 1) & (e <= 64)
                    c = np.where(ok, self.child[node, np.clip(e, 0, 64)], -1)
                    ok = c >= 0
                    nq.append(q[ok])
                    nn.append(c[ok])
                q, node = np.concatenate(nq), np.concatenate(nn).astype(np.int64)


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges (as reps) of the links among the distinct fps."""
    n = len(fps)
    if n == 2:
        return [(int(reps[0]), int(reps[1]))] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    roots = np.arange(n)
    for i, j in BKTree(fps).pairs(radius):
        open_ = roots[i] != roots[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((int(reps[a]), int(reps[b])))
        if open_.any():
            roots = np.array([find(x) for x in range(n)])
    return edges


def near_links(reps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): spanning links between the ``rep`` ids of distinct fingerprints; ``reps`` has (fp, rep)."""
    blocks = radius + 2
    width = 64 // blocks
    cut = [width * i for i in range(blocks)] + [64]
    combos = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]

    def part(i):
        bits = cut[i + 1] - cut[i]
        return F.shiftrightunsigned("fp", cut[i]).bitwiseAND(F.lit((1 << bits) - 1))

    keys = F.array(*(F.xxhash64(F.lit(k), part(i), part(j)) for k, (i, j) in enumerate(combos)))
    dealt = reps.select("fp", "rep", F.explode(keys).alias("shard"))
    # a shard with one fingerprint has no links; the shuffle brings each shard together
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "fp")

    def run(batches):
        held_s, held_f, held_r = (np.empty(0, np.int64) for _ in range(3))

        def forest(s, f, r):
            out = []
            edge = np.flatnonzero(np.diff(s)) + 1
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [len(s)]])
            many = ends - starts > 1
            for a, b in zip(starts[many], ends[many]):
                out += _forest(f[a:b].view(np.uint64), r[a:b], radius)
            return out

        def pack(edges):
            x = np.array(edges, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        for b in batches:
            f, r, s = (np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for h, k in ((held_f, 0), (held_r, 1), (held_s, 2)))
            if not len(s):
                continue
            cut_at = int(np.searchsorted(s, s[-1], "left"))
            if cut_at:
                yield pack(forest(s[:cut_at], f[:cut_at], r[:cut_at]))
            held_s, held_f, held_r = s[cut_at:], f[cut_at:], r[cut_at:]
        if len(held_s):
            yield pack(forest(held_s, held_f, held_r))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id_col, fingerprint, component_id): the component is the smallest id reachable by links within the radius.

    Ids are integers; a row with a null id keeps a null component unless its fingerprint has another id.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words, seed), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("id").cast("bigint").alias("rep")).where("rep is not null"), "simhash-reps")
    comps = connected_components(near_links(reps, radius))
    of = reps.join(comps, reps.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(of, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of fingerprints: that of the smallest id, then of the least hash of its text
    and of its other columns. An id may stand on unrelated texts: each has its own component. Rows with a null id stay."""
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("__th", th).withColumn("__rh", F.xxhash64("__th", *(c for c in docs.columns if c != text_col)))
    named = keyed.where(F.col(id_col).isNotNull())
    rows = named.select(F.struct(F.col(id_col).alias("id"), F.col("__th").alias("th"), F.col("__rh").alias("rh")).alias("key"), F.col(text_col).alias("t"))
    fps = materialize(fingerprints(rows, "key", "t").select("fp", "id.*"), "simhash")
    comps = connected_components(near_links(fps.select("fp", F.col("fp").alias("rep")).distinct()))
    held = fps.groupBy("fp", "id", "th", "rh").agg(F.count("*").alias("n")).join(comps, F.col("fp") == comps.node, "left")
    least = held.groupBy(F.coalesce("component", "fp")).agg(F.min(F.struct("id", "th", "rh", "n")).alias("one"))
    chosen = materialize(least.select("one.*"), "simhash-kept")
    # texts are shuffled once at every size; the ids are the build side, so texts aren't sorted
    keep = chosen.select(F.col("id").alias("__id"), F.col("th").alias("__th2"), F.col("rh").alias("__rh2")).hint("shuffle_hash")
    out = named.join(keep, (F.col(id_col) == F.col("__id")) & (F.col("__th") == F.col("__th2")) & (F.col("__rh") == F.col("__rh2")), "left_semi")
    if chosen.where("n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__th", "__rh"])
    return out.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
