"""Aggregations, rankings and rule chains over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_groups(df: DataFrame, keys: list[str], order: str, ts: str, raw: str, state: str | None = None, by: list[str] | None = None, sites: str | None = None) -> DataFrame:
    """Groups of equal ``keys``: count, time of the first and last row in ``order``, the first row's text and, if given,
    counts per state as a map and the distinct values of the array ``sites`` as they come first."""
    by = by or []
    g = df.groupBy(*by, *keys).agg(
        F.count("*").alias("n"), F.min_by(ts, order).alias("first_ts"), F.max_by(ts, order).alias("last_ts"),
        F.min(order).alias("first_seq"), F.min_by(raw, order).alias("sample"),
    )
    if state:
        per = df.groupBy(*by, *keys, state).agg(F.count("*").alias("c"))
        g = _beside(g, per.groupBy(*by, *keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(state), F.col("c"))))).alias("by_state")), [*by, *keys])
    if sites:
        per = df.select(*by, *keys, order, F.posexplode(sites).alias("i", "site")).groupBy(*by, *keys, "site").agg(F.min(F.struct(order, "i")).alias("at"))
        g = _beside(g, per.groupBy(*by, *keys).agg(F.array_sort(F.collect_list(F.struct("at", "site")))["site"].alias("sites")), [*by, *keys])
        g = g.withColumn("sites", F.coalesce("sites", F.array().cast("array<string>")))
    return g


def _beside(g: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``g`` with the other columns of ``side``; null keys are equal."""
    same = [g[k].eqNullSafe(side[k]) for k in keys]
    return g.join(side, reduce(Column.__and__, same), "left").select(*(g[c] for c in g.columns), *(side[c] for c in side.columns if c not in keys))


def histogram(df: DataFrame, by: list[str], value: Column, name: str = "value") -> DataFrame:
    return df.select(*by, value.alias(name)).where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count("*").alias("n"))


def matches_histogram(df: DataFrame, by: list[str], text: Column, pattern: str, group: int = 1, order: str | None = None) -> DataFrame:
    """Counts of all matches in all rows, by the matched text; with ``order``, also ``first``, where each comes first."""
    hits = df.select(*by, F.lit(0).alias("__o") if order is None else F.col(order).alias("__o"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("__i", "value"))
    g = hits.groupBy(*by, "value")
    return g.agg(F.count("*").alias("n")) if order is None else g.agg(F.count("*").alias("n"), F.min(F.struct("__o", "__i")).alias("first"))


def capped_counts(df: DataFrame, by: list[str], value: str, position: list[str], cap: int = 20) -> DataFrame:
    """Counts of the first ``cap`` distinct values in order of first appearance, with rank by count."""
    first = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("__p"))
    if by:
        kept = first.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__p"))).where(F.col("__r") <= cap)
    else:  # a bounded sort; what the windows see then are ``cap`` rows
        kept = first.orderBy("__p").limit(cap)
        kept = kept.withColumn("__r", F.row_number().over(Window.orderBy("__p")))
    r = Window.partitionBy(*by).orderBy(F.desc("n"), "__r") if by else Window.orderBy(F.desc("n"), "__r")
    return kept.withColumn("rank", F.row_number().over(r)).drop("__p", "__r")


def top_groups(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order: a bounded sort, not a full one."""
    return df.orderBy(*order).limit(n)


def two_sided_cap(df: DataFrame, by: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    """All rows of a group of at most head + tail, else its first ``head`` and last ``tail``; adds ``total``."""
    w = Window.partitionBy(*by)
    d = df.withColumn("total", F.count("*").over(w)).withColumn("__a", F.row_number().over(w.orderBy(*order)))
    return d.where((F.col("total") <= head + tail) | (F.col("__a") <= head) | (F.col("__a") > F.col("total") - tail)).drop("__a")


def both_ends(df: DataFrame, by: list[str], order: list[Column], back: list[Column], head: int, tail: int) -> DataFrame:
    """As ``two_sided_cap``, for groups of any size: two ranked limits, which are cut before the exchange, and counts. ``back`` is
    ``order`` reversed; adds ``nth``, from 1. Keys aren't null."""
    most = head + tail
    first = df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most)
    last = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*back))).where(F.col("__r") <= tail)
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    first = first.join(n, by).where((F.col("__n") <= most) | (F.col("nth") <= head)).drop("__n")
    last = last.join(n, by).where(F.col("__n") > most).withColumn("nth", (F.col("__n") - F.col("__r") + 1).cast("int"))
    return first.unionByName(last.select(*first.columns))


def rule_chain(rules: list[tuple[Column, object]]) -> Column:
    """The value of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), value if isinstance(value, Column) else F.lit(value)) for cond, value in rules))


def presentation_rules(rules: list[dict], platform: Column, layer: Column, text: Column) -> Column:
    """First matching rule's index: a platform's own rules before shared ones, else by position. Rules have pattern and
    optionally platform and layer."""
    order = sorted(range(len(rules)), key=lambda i: (rules[i].get("platform") is None, i))
    chain = []
    for i in order:
        r = rules[i]
        ok = text.rlike(r["pattern"])
        if r.get("platform"):
            ok = ok & (platform == r["platform"])
        if r.get("layer"):
            ok = ok & (layer == r["layer"])
        chain.append((ok, i))
    return rule_chain(chain)


def suppression_rules(rules: list[dict], flags: dict[str, Column], klass: Column, text: Column) -> Column:
    """First matching suppression's index in file order; a rule can need a capture flag (``when``), a class
    (``class``, prefix-anchored) and be lifted by ``unless``."""
    chain = []
    for i, r in enumerate(rules):
        ok = text.rlike(r["pattern"])
        if r.get("when"):
            ok = ok & F.coalesce(flags.get(r["when"], F.lit(False)), F.lit(False))
        if r.get("class"):
            ok = ok & klass.rlike(f"^(?:{r['class']})")
        if r.get("unless"):
            ok = ok & ~text.rlike(r["unless"])
        chain.append((ok, i))
    return rule_chain(chain)


def activity_bins(df: DataFrame, by: list[str], ts: str, bins: int, weight: Column | None = None, error: Column | None = None) -> DataFrame:
    """(by, bin, weight, has_error): rows per equal time bin between a capture's first and last time."""
    bins = max(40, min(600, bins))
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.where(F.col(ts).isNotNull()).withColumn("__t", sec)
    ends = d.groupBy(*by).agg(F.min("__t").alias("__a"), F.max("__t").alias("__z"))
    d = d.join(ends, by)
    at = F.when(F.col("__z") > F.col("__a"), F.floor((F.col("__t") - F.col("__a")) / (F.col("__z") - F.col("__a")) * bins)).otherwise(0)
    d = d.withColumn("bin", F.least(F.lit(bins - 1), at).cast("int"))
    w = F.lit(1) if weight is None else weight
    return d.groupBy(*by, "bin").agg(F.sum(w).alias("weight"), F.bool_or(F.lit(False) if error is None else error).alias("has_error"))


def grid_cluster(df: DataFrame, by: list[str], x: Column, y: Column, cell: float = 64.0) -> DataFrame:
    """(by, cell_x, cell_y, n, mid_x, mid_y): points per square cell."""
    d = df.select(*by, x.alias("__x"), y.alias("__y")).withColumn("cell_x", F.floor(F.col("__x") / cell)).withColumn("cell_y", F.floor(F.col("__y") / cell))
    return d.groupBy(*by, "cell_x", "cell_y").agg(F.count("*").alias("n"), F.avg("__x").alias("mid_x"), F.avg("__y").alias("mid_y"))


def bounding_box(df: DataFrame, by: list[str], lat: str, lon: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"), F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon"))


def coverage(df: DataFrame, by: list[str], status: str, alarm: float = 0.05) -> DataFrame:
    """(by, total, matched, drift, unknown, unknown_rate, alarm) of classified records."""
    g = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col(status).isin("matched", "passthrough")).alias("matched"), F.count_if(F.col(status) == "drift").alias("drift"), F.count_if(F.col(status) == "unknown").alias("unknown")
    )
    rate = (F.col("unknown") + F.col("drift")) / F.col("total")
    return g.withColumn("unknown_rate", F.round(rate, 4)).withColumn("alarm", rate > alarm)


def findings(parts: list[tuple[str, str, DataFrame]], by: list[str], seq: str) -> DataFrame:
    """Union of rule results (kind, severity, rows with by, seq, detail), high before warn before info, then by rule."""
    rank = {"high": 0, "warn": 1, "info": 2}
    out = None
    for i, (kind, sev, df) in enumerate(parts):
        d = df.select(*by, F.col(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), F.lit(rank[sev]).alias("sev_rank"), F.lit(i).alias("rule_ord"), F.col("detail"))
        out = d if out is None else out.unionByName(d)
    return out


def marker_dedupe(df: DataFrame, keys: list[str], order: str, ts: str, props: list[str], times: int = 12) -> DataFrame:
    """One marker per equal ``keys``: count, first row's ``props``, the first ``times`` times and the last one. The
    times come from a ranked limit, which is cut before the exchange, so a large group isn't collected."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    early = df.select(*keys, ts, order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= times)
    early = early.groupBy(*keys).agg(F.array_sort(F.collect_list(ts)).alias("times"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.min_by(p, order).alias(p) for p in props), F.min(order).alias("first_seq"), F.max(ts).alias("last_ts"))
    cond = None
    for k in keys:
        c = g[k].eqNullSafe(early[k])
        cond = c if cond is None else cond & c
    return g.join(early, cond).select(*(g[c] for c in g.columns), "times")


def rollup_summary(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    return df.rollup(*keys).agg(*(v.alias(k) for k, v in aggs.items()))
