"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, in DataFrame operations only.

A window is a run of ``window`` consecutive item words (a shorter item is one window); as a set it holds the word
shingles of up to ``shingle`` words in it. A document can only contain a window if it holds all its shingles, so the
rarest one is a necessary prefix of length one: (1) one pass over the documents looks each shingle up in the
benchmark's dictionary and keeps the matches with the words that follow; (2) matches are counted, which orders each
window's shingles by rarity over all documents; (3) matches of a window's rarest shingle become candidates whose start
is given by the shingle's place in the window, and must lie inside the document (length and positional bounds);
(4) a candidate is verified word by word against the words kept at its start.

Only benchmark-side tables are broadcast, and only while their row count is at most ``broadcast_rows``; beyond it the
same joins run as shuffle joins. Documents' texts are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; equal items
and equal rows are each reported; items with a null id hit words but are not counted; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_enough

#: What separates words once A-Z are lower case.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text):
    """Array of the words of a text column; empty for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def _words_from_one(text):
    """'' and then the words, so that the first word is at index 1, and one more '' if the text ends in no word. Cheaper
    than filtering out empty strings."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.split(F.concat(F.lit(" "), lower), NOT_WORD, -1)


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(win, words, item): one row per distinct window text and item."""
    items = benchmark.select(F.col(item_col).alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("at")
    cut = items.select("item", "w", start).select("item", F.slice("w", F.col("at"), window).alias("words"))
    return cut.select(F.concat_ws(" ", "words").alias("win"), "words", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``docs``."""
    wins = materialize(windows(benchmark, item_col, item_text, window), "windows")
    distinct = wins.select("win", "words").distinct()
    g = F.least(F.lit(shingle), F.size("words"))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - g)).alias("k")
    # each window's shingles, with the shingle's place in the window
    grams = distinct.select("win", F.size("words").alias("len"), g.alias("g"), "words", at).select(
        "win", "len", "g", "k", F.slice("words", F.col("k") + 1, F.col("g")).alias("gw")
    )
    grams = materialize(grams.withColumn("gram", F.xxhash64(F.lit(7), "gw")), "grams")
    small = small_enough(grams, broadcast_rows)
    maybe = F.broadcast if small else (lambda df: df)

    # (1) one pass over the documents. Row 0 of each document is kept for its word count.
    words = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), _words_from_one(F.col(text_col)).alias("w"))
    words = words.withColumn("n", F.size("w") - 1 - (F.element_at("w", -1) == "").cast("int"))
    sizes = sorted(r[0] for r in grams.select("g").distinct().collect())
    sentinel = 0
    parts = []
    for i, size in enumerate(sizes or [shingle]):
        here = words.select("uid", "id", "n", "w", F.posexplode("w").alias("pos", "first"))
        gw = F.array("first", *(F.get("w", F.col("pos") + j) for j in range(1, size)))
        key = F.xxhash64(F.lit(7), gw)
        usable = (F.col("pos") > 0) & (F.col("pos") + size - 1 <= F.col("n"))
        probe = F.when(F.col("pos") == 0, F.lit(sentinel)).when(usable, key)
        table = grams.where(F.col("g") == size).select("gram", "gw").distinct().select("gram", F.concat_ws(" ", "gw").alias("gt"))
        if i == 0:
            table = table.union(docs.sparkSession.range(1).select(F.lit(sentinel).cast("bigint"), F.lit("")))
        same = (F.col("pos") == 0) | (F.concat_ws(" ", gw) == F.col("gt"))
        found = here.where(probe.isNotNull()).join(maybe(table), (probe == F.col("gram")) & same)
        parts.append(
            found.select("uid", "id", F.col("n").alias("n_words"), "pos", "gram", F.when(F.col("pos") > 0, F.concat_ws(" ", F.slice("w", F.col("pos") + 1, window))).alias("ahead"))
        )
    matches = parts[0]
    for p in parts[1:]:
        matches = matches.union(p)
    matches = materialize(matches, "matches")
    rows = matches.where("pos = 0").select("uid", "id", F.col("n_words").cast("bigint").alias("n_words"))
    hits = matches.where("pos > 0")

    # (2) rarity over all documents; a window with a shingle that never occurs can't occur
    counts = materialize(hits.groupBy("gram").agg(F.count("*").alias("n")), "rarity")
    order = Window.partitionBy("win").orderBy("n", "gram", "k")
    ranked = grams.join(maybe(counts), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(order))
    anchors = ranked.where("r = 1 and n > 0").select("gram", "win", "len", "k")

    # (3) candidates from the necessary prefix, within the bounds
    cand = hits.select("uid", "n_words", "pos", "gram").join(maybe(anchors), "gram")
    cand = cand.select("uid", (F.col("pos") - F.col("k")).alias("pos"), "win", "len", "n_words").where("pos >= 1 and pos + len - 1 <= n_words")

    # (4) the words at the candidate's start
    begin = hits.select("uid", "pos", "ahead").distinct()
    held = cand.join(begin, ["uid", "pos"]).where((F.col("ahead") == F.col("win")) | F.col("ahead").startswith(F.concat("win", F.lit(" "))))
    held = materialize(held.select("uid", "pos", "len", "win"), "held")

    before = Window.partitionBy("uid").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len") - 1
    spans = held.groupBy("uid", "pos").agg(F.max("len").alias("len")).withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = spans.groupBy("uid").agg(F.sum(F.greatest(F.lit(0), end - F.greatest(F.col("reach"), F.col("pos") - 1))).alias("n_hit"))
    names = wins.where("item is not null").select("win", F.col("item").cast("string").alias("item")).distinct()
    per_doc = held.select("uid", "win").distinct().join(maybe(names), "win").select("uid", "item").distinct()
    items = per_doc.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(n_hit, "uid", "left").join(items, "uid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op1_benchmark_decontamination(spark, sf_dir):
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS t, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT places.doc_id, s, places.n, win.item_id FROM places JOIN win ON places.t = win.t AND places.n = win.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
