"""Language-model scores with stupid backoff, over word n-grams of orders 1 to ``order``.

Each document is scored by the whole corpus' n-gram counts: the log score of a word is that of its longest n-gram with
at least ``min_count`` occurrences, log(count / count of its prefix), with log(alpha) for each order that its place in
the document would have allowed and that was given up. Scores are summed per document and averaged over its words.

Count tables, partitioned by n-gram hash, are joined to the exploded n-grams and summed per document. Both sides are
pre-aggregated: tasks gather documents in blocks of about ``block_words`` words and count a block's distinct n-grams.
Its (hash, count) lists, sorted and cut by ranges of the hash, go to the count tables' buckets; a bucket adds the counts
of all blocks and joins the totals back to each block's list; the block looks its n-grams up and sums per document. The
number of buckets grows with the text, so a bucket stays in memory; no bucket holds an n-gram more than once per block,
however frequent it is. Hashes have 56 bits: n distinct n-grams meet another by chance with n / 7e16 each.

Words are runs of characters other than ASCII white space, with A-Z in lower case.

Defined cases: a null, empty or blank text has 0 words, log score 0 and a null average; rows of one id (null too) are
one document, whose sums add, without n-grams across rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, new_path
from .storage import read_file, write_file

_BITS = 56


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Grams:
    """Distinct n-grams of a block: per order, each position's number (-1 if the order reaches before the text), each
    number's prefix number, count and hash."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, lens: np.ndarray, order: int):
        self.lens = lens
        self.depth = np.arange(len(codes), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        width = max(1, len(hashes))
        full = [_mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))]
        self.number, self.parent = [codes.astype(np.int64)], [np.zeros(len(hashes), dtype=np.int64)]
        self.count = [np.bincount(codes, minlength=len(hashes)).astype(np.int64)]
        for k in range(1, order):
            at = np.flatnonzero(self.depth >= k)
            values, inverse, n = np.unique(self.number[-1][at - 1] * width + codes[at], return_inverse=True, return_counts=True)
            number = np.full(len(codes), -1, dtype=np.int64)
            number[at] = inverse
            self.number.append(number)
            self.parent.append(values // width)
            self.count.append(n.astype(np.int64))
            with np.errstate(over="ignore"):
                full.append(_mix(full[-1][values // width] * np.uint64(0xD6E8FEB86659FD93) + hashes[values % width]))
        self.hash = [h >> np.uint64(64 - _BITS) for h in full]

    def slices(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of order ``k`` by hash, and where each bucket's range begins."""
        by = np.argsort(self.hash[k], kind="stable")
        bounds = np.array([(i << _BITS) // buckets for i in range(buckets + 1)], dtype=np.uint64)
        return by, np.searchsorted(self.hash[k][by], bounds, "left")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack(x: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs, byte by byte of all of them, deflated."""
    n = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    return bytes([n]) + zlib.compress(planes.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b[1:]), dtype=np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel()


def score_block(grams: Grams, totals: list[np.ndarray], n_all: int, min_count: int, alpha: float) -> np.ndarray:
    """Sum of log scores per text, given each number's corpus count by order."""
    back = math.log(alpha)
    room = np.minimum(grams.depth, len(totals) - 1)
    best = np.log(totals[0] / max(1, n_all))[grams.number[0]] + room * back
    for k in range(1, len(totals)):
        at = np.flatnonzero(grams.number[k] >= 0)
        n = grams.number[k][at]
        seen = totals[k][n] >= min_count
        at, n = at[seen], n[seen]
        best[at] = np.log(totals[k][n] / totals[k - 1][grams.parent[k][n]]) + (room[at] - k) * back
    owner = np.repeat(np.arange(len(grams.lens)), grams.lens)
    return np.bincount(owner, weights=best, minlength=len(grams.lens))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, block_words: int = 1_000_000, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, n_words, log_score, avg_log_score): one row per distinct id of ``docs``."""
    spark = docs.sparkSession
    out = new_path(spark, "lm-blocks")
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def ask(batches):
        part, n = TaskContext.get().partitionId(), 0
        vocab, codes, ids, lens = defaultdict(count().__next__), [], [], []

        def close():
            nonlocal vocab, codes, ids, lens, n
            block, words = part << 24 | n, len(codes)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in vocab), dtype=np.uint64, count=len(vocab))
            code = np.array(codes, dtype=np.int64)
            body = pa.record_batch([pa.array([pack(code)], pa.large_binary()), pa.array([hashes.tobytes()], pa.large_binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64()))], names=["code", "hash", "id", "len"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema) as w:
                w.write_batch(body)
            write_file(f"{out}/{block}", sink.getvalue().to_pybytes())
            g = Grams(code, hashes, np.array(lens, dtype=np.int64), order)
            vocab, codes, ids, lens, n = defaultdict(count().__next__), [], [], [], n + 1
            rows = []
            for k in range(order):
                by, edges = g.slices(k, buckets)
                h, c = g.hash[k][by], g.count[k][by].astype(np.uint64)
                for q in np.flatnonzero(np.diff(edges)):
                    a, z = edges[q], edges[q + 1]
                    rows.append((int(q), k, pack(np.diff(h[a:z], prepend=np.uint64(0))[1:]), int(h[a]), pack(c[a:z])))
            # every bucket learns the number of words, for the unigrams' denominator
            rows += [(q, -1, b"", words, b"") for q in range(buckets)]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["q", "block", "k", "h", "first", "c"])

        for b in batches:
            for i, t in zip(*b.columns):
                w = words_of(t.as_py())
                codes.extend(map(vocab.__getitem__, w))
                ids.append(i.as_py())
                lens.append(len(w))
                if len(codes) >= block_words:
                    yield close()
        if codes:
            yield close()

    def answer(batches):
        """The count tables: each bucket adds up its n-grams' counts and joins the totals to the lists of the blocks."""
        for b, starts, ends in grouped(batches):
            for a, z in zip(starts, ends):
                q, block, k, h, first, c = (b.column(i).slice(a, z - a) for i in range(6))
                k, first, block = k.to_numpy(), first.to_numpy(), block.to_numpy()
                words = int(first[k < 0].sum())
                for level in range(order):
                    mine = np.flatnonzero(k == level)
                    if not len(mine):
                        continue
                    lists = [np.uint64(first[i]) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(unpack(h[int(i)].as_py()), dtype=np.uint64)]) for i in mine]
                    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
                    total = np.bincount(inverse, weights=np.concatenate([unpack(c[int(i)].as_py()) for i in mine])).astype(np.uint64)
                    per = np.split(total[inverse], np.cumsum([len(x) for x in lists])[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[mine]), pa.array([level] * len(mine), pa.int32()), pa.array([q[0].as_py()] * len(mine), pa.int32()), pa.array([words] * len(mine), pa.int64()), pa.array([pack(x) for x in per], pa.binary())],
                        names=["block", "k", "q", "words", "total"],
                    )

    def finish(batches):
        for b, starts, ends in grouped(batches):
            for a, z in zip(starts, ends):
                part = b.slice(a, z - a).to_pydict()
                body = pa.ipc.open_stream(read_file(f"{out}/{part['block'][0]}")).read_all().to_pylist()[0]
                g = Grams(unpack(body["code"]).astype(np.int64), np.frombuffer(body["hash"], dtype=np.uint64), np.array(body["len"], dtype=np.int64), order)
                totals = [np.zeros(len(h)) for h in g.hash]
                slices = [g.slices(k, buckets) for k in range(order)]
                for k, q, t in zip(part["k"], part["q"], part["total"]):
                    by, edges = slices[k]
                    totals[k][by[edges[q] : edges[q + 1]]] = unpack(t)
                sums = score_block(g, totals, part["words"][0], min_count, alpha)
                yield pa.RecordBatch.from_arrays([pa.array(body["id"], pa.int64()), pa.array(g.lens), pa.array(sums, pa.float64())], names=["id", "n", "s"])

    asked = src.mapInArrow(ask, "q int, block bigint, k int, h binary, first bigint, c binary")
    # ranges of a few buckets a task, whatever the session's number of partitions
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, -(-buckets // 2)))
    told = asked.repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(answer, "block bigint, k int, q int, words bigint, total binary")
    scored = told.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(finish, "id bigint, n bigint, s double")
    # documents without words still need a row
    every = src.select("id", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"))
    sums = scored.union(every).groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("s").alias("log_score"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("avg_log_score"))


def op9_lm_score(spark, sf_dir):
    """Scores to six decimals: sums of doubles depend on the order of adding."""
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("avg_log_score", 6).alias("avg_log_score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT u, doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT u, doc_id, i, a, lag(a) OVER o AS b, lag(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY u ORDER BY i)),
c1 AS (SELECT a, count(*) AS n FROM g GROUP BY a),
c2 AS (SELECT b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT g.doc_id, CASE
        WHEN c3.n >= 2 THEN ln(c3.n / p2.n)
        WHEN c2.n >= 2 THEN ln(c2.n / p1.n) + (least(g.i, 3) - 2) * ln(0.4)
        ELSE ln(c1.n / (SELECT count(*) FROM g)) + (least(g.i, 3) - 1) * ln(0.4) END AS x
      FROM g JOIN c1 ON c1.a = g.a LEFT JOIN c2 ON c2.b = g.b AND c2.a = g.a LEFT JOIN c3 ON c3.c = g.c AND c3.b = g.b AND c3.a = g.a
      LEFT JOIN c1 p1 ON p1.a = g.b LEFT JOIN c2 p2 ON p2.b = g.c AND p2.a = g.b),
t AS (SELECT doc_id, count(*) AS n, sum(x) AS s FROM s GROUP BY doc_id)
SELECT e.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_words, round(coalesce(t.s, 0.0), 6) AS log_score, round(t.s / t.n, 6) AS avg_log_score
FROM (SELECT DISTINCT doc_id FROM documents) e LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM e.doc_id
"""
