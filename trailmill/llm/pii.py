"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from one strict pattern per kind. Looser patterns propose further spans of the same kinds. Labelers
vote on every proposal: +1 personal, -1 not, 0 abstain. They are regexes on the span, gazetteers (mail domain endings,
card issuer prefixes, private networks) and the words before the span. Votes are counted by pattern over all
proposals; expectation-maximisation over these counts (at most 3 ** labelers of them) estimates each labeler's
reliability without labels. Its posteriors are the soft labels of the final span classifier, a naive Bayes model over
span features. A proposal that isn't a base span is added if the classifier gives it at least ``threshold`` and it
overlaps no base span. Base spans always stay.

Positions are code points: a text is split at the matches of a pattern, and the lengths of what lies between and of
the matches add up. Patterns match in linear time on any text: possessive runs, and a run is entered only at its start
or where the last match ended, which changes no result.

Defined cases: a null text is empty; a text without spans has counts 0, the digest of '' and spans ''; equal rows get
equal results; other columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, in a form that takes linear time.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser proposals; {kind: pattern}. A phone number without a plus, an obfuscated address.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: Fixed values of the gazetteers.
TLDS = ["com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io"]
CARD_PREFIX = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
PRIVATE_NET = r"^(?:10|127|0|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|from|to)\W*\z",
    "ip": r"(?i)(?:ip|host|server|addr(?:ess)?|from|at)\W*\z",
    "card": r"(?i)(?:card|visa|credit|account|no|number)\W*\z",
    "phone": r"(?i)(?:call|tel|phone|mobile|fax|dial|at)\W*\z",
}
#: Words that say that the number or name after them is something else.
AGAINST = r"(?i)(?:version|isbn|page|figure|example|order|ref|id|total|price)\W*\z"
AROUND = 40


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Luhn's test of a column of digits."""
    d = F.transform(F.split(F.reverse(s), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(13, 19) & _luhn(F.when(n <= 19, _digits(s)).otherwise(""))
    return n.between(9, 15)


def _found(text: Column, kind: str, pattern: str, base: bool, gate: Column) -> Column:
    """Array of matches: (kind, base, i, skipped, hit, before, after); skipped is the length of what lies before."""
    empty = F.array().cast("array<string>")
    hits = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    parts = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(empty)
    k = KINDS.index(kind)

    def row(h, i):
        p = F.get(parts, i)
        return F.struct(
            F.lit(k).alias("k"), F.lit(base).alias("base"), i.alias("i"), F.char_length(p).alias("skipped"), h.alias("hit"),
            F.right(p, F.lit(AROUND)).alias("before"), F.left(F.get(parts, i + 1), F.lit(AROUND)).alias("after"),
        )

    return F.transform(hits, row)


def proposals(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(uid, id, text hash) per row, and (uid, k, base, start, stop, hit, before, after) per valid proposal."""
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    digit = t.rlike("[0-9]")
    gates = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": t.contains("+")}
    arrays = [_found(t, k, p, True, gates[k]) for k, p in BASE.items()]
    loose = {"email": t.rlike(r"(?:at|AT)[\])]"), "phone": t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")}
    arrays += [_found(t, k, p, False, loose[k]) for k, p in LOOSE.items()]
    raw = materialize(src.select("uid", "id", F.xxhash64("t").alias("th"), F.concat(*arrays).alias("m")), "pii")
    m = raw.select("uid", F.inline("m"))
    w = Window.partitionBy("uid", "k", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("skipped") + F.char_length("hit")).over(w)
    m = m.withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("hit"))
    ok = F.lit(False)
    for i, kind in enumerate(KINDS):
        ok = F.when((F.col("k") == i), _valid(kind, F.col("hit"))).otherwise(ok)
    return raw.select("uid", "id", "th"), m.where(ok).select("uid", "k", "base", "start", "stop", "hit", "before", "after")


def _votes() -> dict[str, Column]:
    """Labelers: names and votes."""
    hit, k = F.col("hit"), F.col("k")
    of = {kind: k == i for i, kind in enumerate(KINDS)}
    low = F.lower(hit)

    def vote(*cases):
        out = F.lit(0)
        for cond, v in reversed(cases):
            out = F.when(cond, v).otherwise(out)
        return out.cast("int")

    tld = F.regexp_extract(low, r"([a-z]+)\z", 1).isin(TLDS)
    near = F.lit(False)
    for kind, p in CONTEXT.items():
        near = near | (of[kind] & F.col("before").rlike(p))
    return {
        "regex_shape": vote(
            (of["email"] & low.rlike(r"^[a-z0-9._%+-]{1,64}@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}\z"), 1), (of["email"], -1),
            (of["ip"] & hit.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}\z"), 1), (of["ip"], -1),
            (of["card"] & hit.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\z"), 1), (of["card"], -1),
            (of["phone"] & hit.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}\z"), 1), (of["phone"], -1),
        ),
        "gazetteer": vote(
            (of["email"] & tld, 1), (of["email"], -1), (of["ip"] & hit.rlike(PRIVATE_NET), -1),
            (of["card"] & _digits(hit).rlike(CARD_PREFIX), 1), (of["card"], -1),
            (of["phone"] & hit.rlike(r"^(?:\+[1-9]|\()"), 1),
        ),
        "context_for": vote((near, 1)),
        "context_against": vote((F.col("before").rlike(AGAINST), -1)),
        "boundary": vote((F.col("before").rlike(r"[A-Za-z0-9]\z") | F.col("after").rlike(r"^[A-Za-z0-9]"), -1), (F.lit(True), 1)),
    }


def _features() -> dict[str, Column]:
    """Small-valued features of the final classifier: {name: string column}."""
    hit = F.col("hit")
    n = F.length(_digits(hit))
    return {
        "kind": F.col("k").cast("string"),
        "digits": F.concat_ws(":", "k", F.least(n, F.lit(20)).cast("string")),
        "marks": F.concat_ws(":", "k", F.left(F.regexp_replace(F.regexp_replace(hit, "[A-Za-z0-9]+", "x"), "x(?=x)", ""), F.lit(12))),
        "left": F.when(F.col("before") == "", "^").otherwise(F.translate(F.right("before", F.lit(1)), "0123456789", "0000000000")),
        "right": F.when(F.col("after") == "", "$").otherwise(F.translate(F.left("after", F.lit(1)), "0123456789", "0000000000")),
        "near": F.when(F.col("vote_context_for") > 0, "y").otherwise("n"),
    }


def em(patterns: dict[tuple, int], rounds: int = 50, prior: float = 0.7) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple, float]]:
    """Dawid and Skene's EM for two classes over counted vote patterns: prior, reliabilities, posterior per pattern."""
    post = {p: 1 / (1 + math.exp(-sum(p))) for p in patterns}
    n = len(next(iter(patterns), ()))
    table: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        pos = sum(c * post[p] for p, c in patterns.items())
        total = sum(patterns.values())
        prior = (pos + 1) / (total + 2)
        table = []
        for j in range(n):
            row = {}
            for v in (-1, 0, 1):
                a = sum(c * post[p] for p, c in patterns.items() if p[j] == v)
                b = sum(c * (1 - post[p]) for p, c in patterns.items() if p[j] == v)
                row[v] = ((a + 1) / (pos + 3), (b + 1) / (total - pos + 3))
            table.append(row)
        new = {}
        for p in patterns:
            x = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        if max((abs(new[p] - post[p]) for p in patterns), default=0) < 1e-9:
            post = new
            break
        post = new
    return prior, table, post


def weak_supervision(spans: DataFrame, threshold: float) -> DataFrame:
    """``spans`` that are base, or that the classifier accepts. Collects counted vote patterns (at most 729) only."""
    votes = _votes()
    names = [f"vote_{x}" for x in votes]
    voted = materialize(spans.withColumns({f"vote_{x}": v for x, v in votes.items()}), "votes")
    counted = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).count().collect()}
    _, _, post = em(counted)
    # posteriors as soft labels
    soft = F.lit(0.5)
    for p, v in post.items():
        same = F.lit(True)
        for name, x in zip(names, p):
            same = same & (F.col(name) == x)
        soft = F.when(same, F.lit(v)).otherwise(soft)
    feats = _features()
    pairs = F.array(*(F.struct(F.lit(i).alias("f"), v.alias("v")) for i, v in enumerate(feats.values())))
    soft_rows = voted.withColumn("soft", soft).withColumn("pairs", pairs)
    totals = soft_rows.agg(F.sum("soft"), F.sum(1 - F.col("soft"))).first()
    pos, neg = (totals[0] or 0.0), (totals[1] or 0.0)
    # naive Bayes weights per feature value; the values that proposals beyond the base can have are what is joined
    weights = soft_rows.select("soft", F.inline("pairs")).groupBy("f", "v").agg(F.sum("soft").alias("a"), F.sum(1 - F.col("soft")).alias("b"))
    # smoothed towards a value's share of all proposals, so that a rare value says little either way
    share = (F.col("a") + F.col("b")) / max(pos + neg, 1e-9)
    weights = weights.select("f", "v", (F.log((F.col("a") + share) / (pos + 1.0)) - F.log((F.col("b") + share) / (neg + 1.0))).alias("wt"))
    more = soft_rows.where(~F.col("base"))
    keyed = more.withColumn("sid", F.xxhash64("uid", "k", "start", "stop"))
    scored = keyed.select("sid", F.inline("pairs")).join(weights, ["f", "v"]).groupBy("sid").agg(F.sum("wt").alias("s"))
    bias = math.log((pos + 1.0) / (neg + 1.0))
    good = scored.where(1 / (1 + F.exp(-(F.col("s") + bias))) >= threshold).select("sid").distinct()
    cols = ["uid", "k", "start", "stop", "hit"]
    base = spans.where("base").select(*cols, F.lit(True).alias("base"))
    added = keyed.join(good, "sid", "left_semi").select(*cols)
    b = base.select("uid", F.col("start").alias("s0"), F.col("stop").alias("e0"))
    clash = (added.uid == b.uid) & (F.col("start") < F.col("e0")) & (F.col("s0") < F.col("stop"))
    added = added.join(b, clash, "left_anti").distinct()
    return base.union(added.select(*cols, F.lit(False).alias("base")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(uid, id, text hash) per row of ``docs`` and (uid, k, start, stop, hit, base) per span."""
    rows, spans = proposals(docs, id_col, text_col)
    spans = materialize(spans, "spans")
    return rows, weak_supervision(spans, threshold)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans): the counts are of base spans."""
    rows, spans = find_pii(docs, id_col, text_col, threshold)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    item = F.struct("k", "start", "stop", F.concat_ws(":", name, "start", "stop").alias("s"))
    per = spans.groupBy("uid").agg(
        *(F.count_if(F.col("base") & (F.col("k") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("b"), F.array_sort(F.collect_list(item)).alias("a"),
    )
    out = rows.join(per, "uid", "left")
    text = lambda c: F.coalesce(F.concat_ws(",", F.col(c)["s"]), F.lit(""))
    return out.select(
        F.col("id").alias(id_col), *(F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(text("b"), 256).alias("base_sha256"), text("a").alias("spans"),
    )


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each of the ordered ``spans`` (start, stop, k) replaced by its kind in angle brackets."""
    name = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        kept = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - a["at"]).cast("int"))
        at = F.greatest(a["at"], s["stop"]).cast("bigint")
        return F.struct(at.alias("at"), F.concat(a["out"], F.array(kept, F.element_at(name, s["k"] + 1))).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.concat_ws("", a["out"]), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """``docs`` with all spans masked; rows without spans stay as they are. Rows meet their spans by id and text hash."""
    rows, spans = find_pii(docs, id_col, text_col, threshold)
    keyed = spans.join(rows, "uid").select(F.col("id").alias("__id"), F.col("th").alias("__th"), "start", "stop", "k").distinct()
    lists = keyed.groupBy("__id", "__th").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "k"))).alias("__spans"))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("__th2", th).join(lists, (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__th2") == F.col("__th")), "left")
    masked = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(mask(F.col(text_col), F.col("__spans")))
    return out.withColumn(text_col, masked).select(*docs.columns)


def op6_pii(spark, sf_dir):
    return pii_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
