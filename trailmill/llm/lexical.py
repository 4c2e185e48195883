"""Ranked lexical search: the k best documents of each item, by a threshold-seeded join over stored postings.

1. One pass over the texts stores a posting (document, term, tf) for each term of an item, with the document's length.
2. Per term: df, weight, the largest impact and the kth largest one (rounded down to a thousandth of the saturation's
   range, by counts per level, so no task sorts a term's postings). An item's kth score is at least the largest kth impact of
   its terms.
3. The seed: postings of the item's rarest terms, together at most ``seed_rows``, summed per document; the kth largest sum
   raises the bound. Nothing is dropped here: a sum over some terms is a lower bound of a score.
4. Terms are ordered by largest impact. While their sum, from the least on, is below the bound, they cannot lift a document
   over it alone: only the postings of the others make candidates. A candidate's sum plus the largest impacts of the
   left-out terms has to reach the bound, and that of the kth best sum of candidates.
5. Left-out terms of the remaining candidates are joined and added: exact scores, of which the k highest are the result.

All bounds prune strictly below, so ties stay in. Postings are broadcast nowhere; item terms, seeds and candidates only under a
checked number of rows, else they meet in a shuffle join.

Defined cases: null texts have no term; rows of one item_id (null too) are one item, each row of documents is a document of its
own; an item without a term in any document has no rows; null doc_ids come after all others among equal scores; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gapless, materialize, new_path, small_enough

#: 0-9 and all beyond ASCII stay, A-Z become small, all else separates.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 1_000_000  # no saturation reaches it
LEVEL = TOP // 1_000
WHOLE = -1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def postings(docs: DataFrame, vocabulary: DataFrame, broadcast_rows: int) -> DataFrame:
    """(uid, doc_id, n, term, tf): per row of ``docs`` one with term -1, and one per term of ``vocabulary`` (term, word)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    known = None
    if small_enough(vocabulary, broadcast_rows):
        known = spark.sparkContext.broadcast({r.word.encode("utf-8", "surrogatepass"): r.term for r in vocabulary.toLocalIterator()})

    def read(batches):
        number = known.value if known else None
        for b in batches:
            uid, doc, text = b.columns
            keep, times, lengths, terms, tfs = [], [], [], [], []

            def close():
                n = np.array(times)
                out = [uid.take(pa.array(np.repeat(keep, n))), doc.take(pa.array(np.repeat(keep, n))), pa.array(np.repeat(np.array(lengths, dtype=np.int64), n)), pa.array(terms, pa.int32() if known else pa.string()), pa.array(tfs, pa.int64())]
                for x in (keep, times, lengths, terms, tfs):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, names=["uid", "doc_id", "n", "term", "tf"])

            for i, t in enumerate(text):
                words = terms_of(t.as_py())
                if known:
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    terms.append(WHOLE)
                    terms.extend(found)
                else:
                    found = Counter(words)
                    terms.append(None)
                    terms.extend(w.decode("utf-8", "surrogatepass") for w in found)
                tfs.append(len(words))
                tfs.extend(found.values())
                keep.append(i)
                times.append(len(found) + 1)
                lengths.append(len(words))
                if len(terms) > 200_000:
                    yield close()
            if keep:
                yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    path = new_path(spark, "postings")
    if known:
        rows.mapInArrow(read, f"uid bigint, doc_id {kind}, n bigint, term int, tf bigint").write.parquet(path)
        return spark.read.parquet(path)
    rows.mapInArrow(read, f"uid bigint, doc_id {kind}, n bigint, term string, tf bigint").write.parquet(path)
    every = spark.read.parquet(path).withColumnRenamed("term", "word")
    of = every.where("word IS NOT NULL").join(vocabulary, "word").select("uid", "doc_id", "n", "term", "tf")
    return materialize(of.union(every.where("word IS NULL").select("uid", "doc_id", "n", F.lit(WHOLE), "tf")), "postings")


def _near(df: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, broadcast_rows) else df


def _kth(scores: DataFrame, score: str, k: int) -> DataFrame:
    """(item, kth): the kth largest ``score`` of the items that have as many; tasks send at most k rows an item."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col(score).desc()))
    return scores.select("item", score, rank.alias("rank")).where(F.col("rank") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min(score).alias("kth")).where(F.col("n") == k).select("item", "kth")


def search(docs: DataFrame, items: DataFrame, k: int = 10, seed_rows: int = 2_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text).

    ``seed_rows`` bounds the work of the first bound, ``broadcast_rows`` what is broadcast; neither changes the result.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("word")).distinct()
    asked = materialize(asked, "item-words")
    vocabulary = materialize(_numbered(asked.select("word").distinct(), "word", "term"), "item-terms")
    ids = materialize(_numbered(asked.select("item_id").distinct(), "item_id", "item"), "items")
    post = postings(docs, vocabulary, broadcast_rows)
    whole = post.where(F.col("term") == WHOLE).agg(F.count(F.when(F.col("n") > 0, 1)), F.sum(F.col("n").cast("decimal(38,0)")), F.max("n")).first()
    n_docs, n_all, longest = whole[0], int(whole[1] or 1) or 1, whole[2] or 0
    part = F.col("n") * F.lit(90 * n_docs)
    if 90 * n_docs * longest >= 1 << 63:
        part = F.col("n").cast("decimal(38,0)") * F.lit(90 * n_docs).cast("decimal(20,0)")
    m = F.lit(100 - 90) + F.expr("p div L").cast("bigint")
    post = post.where(F.col("term") != WHOLE).withColumn("p", part).withColumn("L", F.lit(n_all)).withColumn("m", m)
    post = post.withColumn("sat", F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")).select("uid", "doc_id", "term", "sat")

    levels = post.groupBy("term", F.floor(F.col("sat") / LEVEL).cast("int").alias("level")).agg(F.count("*").alias("n"), F.max("sat").alias("top"))
    down = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("level").desc()))
    per = levels.withColumn("upto", down).groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.max(F.when(F.col("upto") >= k, F.col("level") * LEVEL)).alias("kth"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    stored = materialize(per.withColumn("w", w).select("term", "df", "w", (F.col("w") * F.col("top")).alias("top"), (F.col("w") * F.coalesce("kth", F.lit(0))).alias("kth")), "term-impacts")

    same = asked["item_id"].eqNullSafe(ids["item_id"])
    terms = asked.join(ids, same).join(vocabulary, "word").select("item", "term").join(stored, "term")
    item = Window.partitionBy("item")
    rarest = item.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = materialize(terms.select("*", F.max("kth").over(item).alias("bound"), (F.sum("df").over(rarest) <= seed_rows).alias("seed")), "item-bounds")

    seeds = _near(terms.where("seed").select("item", "term", "w"), broadcast_rows)
    sums = post.join(seeds, "term").groupBy("item", "uid").agg(F.sum(F.col("w") * F.col("sat")).alias("score"))
    seeded = _kth(sums, "score", k)
    least = item.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = terms.drop("kth").join(seeded, "item", "left").withColumn("bound", F.greatest("bound", F.coalesce("kth", F.lit(0))))
    out_of = F.sum("top").over(least) < F.col("bound")
    bounded = materialize(bounded.select("item", "term", "w", "top", "bound", out_of.alias("left_out")), "item-bounds")
    rest = bounded.groupBy("item").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("left_out"), F.col("top"))), F.lit(0)).alias("rest"))

    makers = _near(bounded.where("NOT left_out").select("item", "term", "w"), broadcast_rows)
    sums = post.join(makers, "term").groupBy("item", "uid").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("sat")).alias("score"))
    reach = sums.join(_near(rest, broadcast_rows), "item").where(F.col("score") + F.col("rest") >= F.col("bound"))
    reach = materialize(reach.select("item", "uid", "doc_id", "score", "rest"), "candidates")
    best = reach.join(_near(_kth(reach, "score", k), broadcast_rows), "item", "left").where(F.col("kth").isNull() | (F.col("score") + F.col("rest") >= F.col("kth")))
    best = materialize(best.select("item", "uid", "doc_id", "score"), "candidates")

    missing = best.select("item", "uid").join(_near(bounded.where("left_out").select("item", "term", "w"), broadcast_rows), "item")
    added = post.select("uid", "term", "sat").join(_near(materialize(missing, "rescored"), broadcast_rows), ["uid", "term"])
    exact = best.unionByName(added.select("item", "uid", F.lit(None).cast(best.schema["doc_id"].dataType).alias("doc_id"), (F.col("w") * F.col("sat")).alias("score")))
    exact = exact.groupBy("item", "uid").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("score").alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid"))
    ranked = exact.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def _numbered(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values with numbers from 0, by counts per partition: no task sees them all."""
    return gapless(materialize(df, "values"), [], [col], out).withColumn(out, F.col(out).cast("int"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
p AS (SELECT u, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT u, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
g AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * max(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT i.item_id, f.u, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + ((90 * f.n * g.big_n) // g.big_l))))) AS BIGINT) AS score
      FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term, g GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, u) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
