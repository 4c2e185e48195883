"""Pseudonymization: stable aliases per kind, numbered by first encounter, and their application to text.

Passes run in a fixed order, each on what the ones before left: registered exact strings, URLs, position pairs, UUIDs,
dotted names. A pass splits a text at its matches and looks each match up in the capture's aliases, so a string is
replaced only where it stands as a whole; a match without an alias becomes '<PREFIX>-?', never the plain string."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import alias_letters, valid_position
from ..operators import scan
from ..operators.shared import written

# Characters that end a URL besides white space, and those that don't count at its end.
URL_STOPS = "\"'<>]),;|}"
URL_TAIL = ".,;:'\""
# Namespaces of platforms, which identify nobody. A parameter; add those of your own libraries.
ALLOWED = ["android.", "androidx.", "java.", "javax.", "kotlin.", "kotlinx.", "dalvik.", "libcore.", "sun.", "com.android.", "com.google.", "io.flutter.", "org.apache.", "org.json."]
# Alias prefixes.
PREFIX = {"coord": "COORD", "gf": "GF", "uuid": "UUID", "pkg": "PKG", "dev": "DEV", "url": "URL"}

_NUMBER = "[+-]?[0-9]{1,3}[.][0-9]++"
_SEGMENT = "[A-Za-z][\\w$]*+"
#: What each pass looks for; positions may stand in angle brackets.
PASSES = {
    "url": f"\\b[A-Za-z][A-Za-z0-9+.-]*+://[^\\s{re.escape(URL_STOPS)}]+",
    "coord": f"(?:<\\s*)?(?<![\\w.]){_NUMBER}\\s*,\\s*{_NUMBER}(?![0-9.])(?:\\s*>)?",
    "uuid": "-".join(f"[0-9A-Fa-f]{{{n}}}" for n in (8, 4, 4, 4, 12)),
    "pkg": f"(?<![\\w.$@-]){_SEGMENT}(?:[.]{_SEGMENT}){{2,}}",
}

#: What a text needs for a pass to find anything; texts without it are not split.
GATES = {"url": "://", "coord": "[0-9]\\s*,\\s*[+-]?[0-9]", "uuid": "[0-9A-Fa-f]{8}-", "pkg": "[\\w$][.][A-Za-z]"}


def _read(kind: str, x: Column, allowed: list[str]) -> Column:
    """A match as (key, raw, ok, bracketed): its identity, the part to replace, whether it counts."""
    key = raw = x
    ok, bracketed = F.lit(True), F.lit(False)
    if kind == "url":
        key = raw = F.rtrim(x, F.lit(URL_TAIL))
    elif kind == "coord":
        raw = F.btrim(x, F.lit("<> \t\n\r\f\v"))
        parts = F.transform(F.split(raw, "\\s*,\\s*"), lambda p: F.ltrim(p, F.lit("+")))
        key = F.array_join(parts, ",")
        bracketed = x.startswith("<") & x.endswith(">")
        precise = F.forall(parts, lambda p: F.length(F.substring_index(p, ".", -1)) >= 3)
        ok = valid_position(parts[0].try_cast("double"), parts[1].try_cast("double")) & (bracketed | precise)
    elif kind == "uuid":
        key = F.lower(x)
    elif kind == "pkg":
        for name in allowed:
            ok = ok & ~x.startswith(name)
    return F.struct(key.alias("key"), raw.alias("raw"), ok.alias("ok"), bracketed.alias("bracketed"))


def _matches(text: Column, kind: str) -> Column:
    return F.when(text.rlike(GATES[kind]), F.regexp_extract_all(text, F.lit(PASSES[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _masked(text: Column, kind: str, alias, allowed: list[str]) -> Column:
    """``text`` with ``alias(key)`` for each match of a pass that counts."""

    def one(x):
        hit = _read(kind, x, allowed)
        return F.when(hit["ok"], F.replace(x, hit["raw"], alias(hit["key"]))).otherwise(x)

    gaps = F.split(text, PASSES[kind], -1)
    whole = F.array_join(F.zip_with(gaps, F.transform(_matches(text, kind), one), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(GATES[kind]), whole).otherwise(text)


def found(df: DataFrame, text: str, allowed: list[str] = ALLOWED) -> DataFrame:
    """``df`` with ``hits``, all strings of a text that need an alias: (kind, pass, pos, key, raw), bracketed positions
    before bare ones. Each pass is a column of its own, so none is evaluated again inside the next."""
    d, parts = df.withColumn("__t0", F.col(text)), []
    for n, kind in enumerate(PASSES):
        now = F.col(f"__t{n}")

        def one(x, i):
            hit = _read(kind, x, allowed)
            order = F.when(hit["bracketed"], 2 * n).otherwise(2 * n + 1)
            return F.struct(F.lit(kind).alias("kind"), order.alias("pass"), i.alias("pos"), hit["key"].alias("key"), hit["raw"].alias("raw"), hit["ok"].alias("ok"))

        parts.append(F.transform(_matches(now, kind), one))
        d = d.withColumn(f"__t{n + 1}", _masked(now, kind, lambda key: F.lit(PREFIX[kind]), allowed))
    hits = F.filter(F.concat(*parts), lambda x: x["ok"])
    return d.withColumn("hits", hits).drop(*(f"__t{n}" for n in range(len(PASSES) + 1)))


def _numbered(registered: DataFrame, by: list[str], letters: Callable[[Column], Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("value"))
    return registered.distinct().select(*by, "kind", F.col("value").alias("key"), F.col("value").alias("raw"), _alias(n, letters).alias("alias"))


def _alias(n: Column, letters: Callable[[Column], Column]) -> Column:
    prefix = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))
    return F.concat(prefix[F.col("kind")], F.lit("-"), letters(n))


def _exact(df: DataFrame, names: DataFrame, by: list[str], text: str) -> DataFrame:
    """``text`` with registered strings replaced, longest first; those of word characters only as whole words."""
    item = F.struct((-F.length("raw")).alias("n"), F.col("raw"), F.col("alias"))
    lists = names.where(F.col("raw") != "").groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias("__names"))

    def step(acc, a):
        word = a["raw"].rlike("^\\w+$")
        return F.when(word, F.regexp_replace(acc, F.concat(F.lit("\\b"), a["raw"], F.lit("\\b")), a["alias"])).otherwise(F.replace(acc, a["raw"], a["alias"]))

    none = F.array().cast(lists.schema["__names"].dataType)
    return df.join(lists, by, "left").withColumn("__text", F.aggregate(F.coalesce("__names", none), F.col(text), step)).drop("__names")


def alias_table(df: DataFrame, by: list[str], order: list[str], text: str, registered: DataFrame | None = None, allowed: list[str] = ALLOWED, large: int = 1_000_000, letters: Callable[[Column], Column] = alias_letters) -> DataFrame:
    """(by, kind, key, raw, alias). ``registered`` (by, kind, value) comes first in its kind, in order of value. ``letters``
    makes a name of a number."""
    names = None if registered is None else _numbered(registered, by, letters)
    d = df.withColumn("__text", F.col(text)) if names is None else _exact(df, names, by, text)
    hits = found(d, "__text", allowed).select(*by, F.struct(*order).alias("at"), F.inline("hits")).select(*by, "kind", "key", "raw", F.struct("at", "pass", "pos").alias("at"))
    first = hits.groupBy(*by, "kind", "key", "raw").agg(F.min("at").alias("at"))
    # one row a string; numbers are running counts, over segments where a capture has many strings
    keys = written(first.groupBy(*by, "kind", "key").agg(F.min("at").alias("at"), F.collect_set("raw").alias("raws")), "aliases")
    at = keys.select(*by, "kind", "key", "raws", *(F.col(f"at.{a}").alias(f"__at{i}") for i, a in enumerate(("at", "pass", "pos"))))
    place = ["__at0", "__at1", "__at2", "key"]
    at = scan.run(scan.deal_if_large(at, [*by, "kind"], place, large), [*by, "kind"], place, __n=scan.total(F.lit(1)))
    out = at.select(*by, "kind", "key", F.explode("raws").alias("raw"), _alias(F.col("__n"), letters).alias("alias"))
    return out if names is None else out.unionByName(names)


def apply_aliases(df: DataFrame, table: DataFrame, by: list[str], text: str, out: str = "redacted", allowed: list[str] = ALLOWED) -> DataFrame:
    """``out``: the text with aliases. A capture's aliases travel with its rows as a map: a capture is one device's log
    and has few of them. Cost grows with a text's matches, not with the aliases."""
    d = _exact(df, table.where(F.col("kind").isin("gf", "dev")), by, text)
    entry = F.struct(F.concat("kind", F.lit(" "), "key").alias("k"), F.col("alias").alias("v"))
    d = d.join(table.where(F.col("kind").isin(*PASSES)).groupBy(*by).agg(F.map_from_entries(F.collect_set(entry)).alias("__map")), by, "left")
    for kind in PASSES:
        look = lambda key: F.coalesce(F.col("__map")[F.concat(F.lit(kind + " "), key)], F.lit(PREFIX[kind] + "-?"))
        d = d.withColumn("__text", _masked(F.col("__text"), kind, look, allowed))
    return d.withColumn(out, F.col("__text")).drop("__text", "__map")
