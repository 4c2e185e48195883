"""Payloads inside records: one ``structs`` column of nullable sub-structs, from built-in expressions behind cheap
substring tests; configuration dumps and property-list errors, whose grammars nest without bound, in one pandas
function over the few records that have them. Nothing raises on malformed text: what doesn't parse is null."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import duration_ms, extract

NUM = "-?\\d+(?:\\.\\d+)?(?:[Ee]-?\\d+)?"
_LOCATION = "(?<![A-Za-z0-9_])Location\\["
#: Where no bracket closes a position: its balanced beginning.
_OPEN_ENDED = "^((?:[^\\[\\]]|\\[(?:[^\\[\\]]|\\[[^\\[\\]]*\\])*\\])*)"
_PIN = "(?m)(?:(\\d+):)?📍<([+-]?\\d+(?:\\.\\d+)?),([+-]?\\d+(?:\\.\\d+)?)>(?:\\s*\\+/-\\s*([\\d.]+)m)?(?:\\s*\\(speed\\s+(-?[\\d.]+)\\s+mps\\s*/\\s*course\\s+(-?[\\d.]+)\\))?(?:\\s*@\\s*([^|\\n]+?))?(?:\\s*\\|\\s*age:\\s*(\\d+)\\s*ms)?\\s*$"
_AB = "(?m)^\\s*╟?─?\\s*([AB]):\\s*(.+?)\\s*$"
_PAIR = "(?:^|[\\s,])?[A-Za-z_]\\w*=" + NUM


def _d(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def _gate(raw: Column, test: Column, value: Column) -> Column:
    return F.when(test, value)


def _non_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def _last_wins(pairs: Column, kind: str) -> Column:
    """Map of (key, value) pairs; of repeated keys the last wins. The pairs are evaluated once."""
    empty = F.create_map().cast(f"map<string,{kind}>")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def closed(rest: Column, opening: str = "[", closing: str = "]") -> Column:
    """Length of what stands before the bracket that closes ``rest``, which begins inside one; null if none does.

    A running depth over the pieces between closing brackets: each opens as many as it holds, and its end closes one."""
    pieces = F.split(rest, "\\" + closing, -1)
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit(opening), F.lit("")))
    start = F.struct(F.lit(1).alias("depth"), F.lit(-1).alias("at"))

    def step(s, p):
        return F.when(s["depth"] > 0, F.struct((s["depth"] + opened(p) - 1).alias("depth"), (s["at"] + F.length(p) + 1).alias("at"))).otherwise(s)

    # the last piece is ended by the text, not by a bracket
    end = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)
    return F.when(end["depth"] == 0, end["at"])


def _bracketed(text: Column) -> Column:
    """(i, t): inside of each outermost position in a text, and the milliseconds written behind it."""
    chunks = F.split(text, _LOCATION, -1)
    size = F.length(F.lit("Location["))
    none = F.array().cast("array<struct<i:string,t:string>>")

    def step(s, chunk):
        # positions are read from where each begins to the end of the text, since another may stand inside it
        begin = s["begin"] + F.length(chunk) + size
        rest = F.substring(text, begin + 1, F.length(text))
        end = closed(rest)
        inner = F.coalesce(F.left(rest, end), F.regexp_extract(rest, _OPEN_ENDED, 1))
        time = F.when(end.isNotNull(), F.regexp_extract(F.substring(rest, end + 2, F.lit(40)), "^, time: (\\d+)", 1))
        taken = F.struct(begin.alias("begin"), (begin + F.length(inner)).alias("until"), F.concat(s["found"], F.array(F.struct(inner.alias("i"), time.alias("t")))).alias("found"))
        return F.when(begin < s["until"], s.withField("begin", begin)).otherwise(taken)

    start = F.struct(F.lit(0).alias("begin"), F.lit(-1).alias("until"), none.alias("found"))
    # the last chunk begins no further position
    return F.aggregate(F.slice(chunks, F.lit(1), F.size(chunks) - 1), start, step)["found"]


def _android_location(inner: Column, time: Column, pairs: Column, head: Column, elapsed: Column) -> Column:
    def num(*keys):
        return F.get(F.filter(pairs, lambda x: x["own"] & x["k"].isin(*keys)), F.lit(0))["v"]

    names = F.reverse(F.transform(pairs, lambda x: x["k"]))
    values = F.reverse(F.transform(pairs, lambda x: x["v"]))
    last = F.array_distinct(names)
    return F.struct(
        _d(F.get(head, F.lit(1))).alias("lat"), _d(F.get(head, F.lit(2))).alias("lon"),
        num("hAcc", "acc").alias("acc"), num("vel").alias("speed"), num("bear").alias("course"), num("alt").alias("alt"),
        F.nullif(F.get(head, F.lit(0)), F.lit("")).alias("provider"), F.lower(inner).rlike("\\bmock\\b").alias("mock"),
        duration_ms(elapsed).alias("et_ms"), F.lit(None).cast("bigint").alias("age_ms"),
        F.lit(None).cast("int").alias("batch_index"), F.nullif(time, F.lit("")).try_cast("bigint").alias("time_ms"), F.lit(None).cast("string").alias("time_text"),
        num("vAcc").alias("vacc"), num("sAcc").alias("sacc"), num("bAcc").alias("bacc"),
        F.map_from_arrays(last, F.transform(last, lambda k: F.element_at(values, F.array_position(names, k).cast("int")))).alias("extras"),
    )


def _pairs(inner: Column) -> Column:
    """key=number of a position: (k, v, own), own if it stands at the begin or behind a blank or comma."""
    hits = F.regexp_extract_all(inner, F.lit(_PAIR), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^[\\s,]", "")
    first = F.substring_index(inner, "=", 1)
    return F.transform(hits, lambda x, i: F.struct(F.substring_index(bare(x), "=", 1).alias("k"), F.substring_index(x, "=", -1).try_cast("double").alias("v"), (x.rlike("^[\\s,]") | ((i == 0) & (first == F.substring_index(x, "=", 1)))).alias("own")))


def _head(inner: Column) -> Column:
    """Provider, latitude and longitude, with which a position begins; an empty array where it doesn't."""
    begin = F.regexp_extract(inner, "^\\S+ -?\\d+(?:\\.\\d+)?,-?\\d+(?:\\.\\d+)?", 0)
    return F.when(begin != "", F.split(begin, "[ ,](?=-?\\d+(?:\\.\\d+)?(?:,|$))", -1)).otherwise(F.array().cast("array<string>"))


def _pin_location(hit: Column) -> Column:
    g = lambda i: F.regexp_extract(hit, _PIN, i)
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        _d(g(2)).alias("lat"), _d(g(3)).alias("lon"), _d(g(4)).alias("acc"), _non_negative(_d(g(5))).alias("speed"), _non_negative(_d(g(6))).alias("course"),
        none("double").alias("alt"), none("string").alias("provider"), F.lit(False).alias("mock"), none("bigint").alias("et_ms"), F.nullif(g(8), F.lit("")).try_cast("bigint").alias("age_ms"),
        F.nullif(g(1), F.lit("")).try_cast("int").alias("batch_index"), none("bigint").alias("time_ms"), F.nullif(F.trim(g(7)), F.lit("")).alias("time_text"),
        none("double").alias("vacc"), none("double").alias("sacc"), none("double").alias("bacc"), none("map<string,double>").alias("extras"),
    )


def bare_text(raw: Column) -> Column:
    """A record without comparison rows (A: and B:), which hold no positions of their own."""
    return F.regexp_replace(raw, "(?m)^\\s*╟?─?\\s*[AB]:\\s*[-\\d].*$", "")


def locations(bare: Column) -> Column:
    """All positions of a record's ``bare_text``, brackets inside them nested to any depth."""
    # each step is an array of its own, so that it is evaluated once per position
    parts = F.transform(_bracketed(bare), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), _pairs(x["i"]).alias("p"), _head(x["i"]).alias("h"), F.nullif(F.regexp_extract(x["i"], "et=\\+?(\\S+)", 1), F.lit("")).alias("e")))
    a = F.when(bare.contains("Location["), F.transform(parts, lambda x: _android_location(x["i"], x["t"], x["p"], x["h"], x["e"])))
    p = F.when(bare.contains("📍<"), F.transform(F.regexp_extract_all(bare, F.lit(_PIN), F.lit(0)), _pin_location))
    return F.filter(F.coalesce(a, p), lambda x: x["lat"].isNotNull() & x["lon"].isNotNull())


def filter_map(raw: Column) -> Column:
    """Keys and values of a location filter's line, of either grammar; null for other records."""
    kv = "([A-Za-z_]\\w*(?:\\(\\w+\\))?)=('[^']*'|[^,\\s\\])]+)"
    line = F.regexp_extract(raw, "(?m)^.*(?:FilterResult|decision=).*$", 0)
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, "^'|'$", ""), "^(-?\\d+(?:\\.\\d+)?)m$", "$1")
    pairs = F.transform(F.regexp_extract_all(line, F.lit(kv), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, kv, 1).alias("k"), clean(F.regexp_extract(x, kv, 2)).alias("v")))
    return F.when(raw.contains("FilterResult") | raw.contains("decision="), _last_wins(pairs, "string"))


def filter_result(found: Column) -> Column:
    """decision, reason and metrics from a ``filter_map``, and everything in it as text."""
    at = lambda k: F.try_element_at(found, F.lit(k))
    num = lambda k: at(k).try_cast("double")
    s = F.struct(
        at("decision").alias("decision"), at("reason").alias("reason"), num("raw").alias("raw"), num("effective").alias("effective"), at("anomaly").alias("anomaly"),
        F.coalesce(num("acc(cur)"), num("acc_cur")).alias("acc_cur"), F.coalesce(num("acc(prev)"), num("acc_prev")).alias("acc_prev"), found.alias("extras"),
    )
    return F.when(F.size(found) > 0, s)


def detected_activity(raw: Column) -> Column:
    p = "DetectedActivity ?\\[type=(\\w+), confidence=(\\d+)\\]"
    return F.when(raw.contains("DetectedActivity") & raw.rlike(p), F.struct(F.regexp_extract(raw, p, 1).alias("type"), F.regexp_extract(raw, p, 2).try_cast("int").alias("confidence")))


def motion_activity(raw: Column) -> Column:
    inner = F.regexp_extract(raw, "(?s)<?CMMotionActivity(.*?)(?:>|$)", 1)
    f = lambda k: F.nullif(F.regexp_extract(inner, f"\\b{k}:(\\d+)", 1), F.lit("")).try_cast("int").alias(k)
    return F.when(
        raw.contains("CMMotionActivity"),
        F.struct(*(f(k) for k in ("st", "walk", "run", "auto", "cyc", "conf")), extract(inner, "start:(.*?)(?= test:|$)").alias("start"), extract(inner, "test:(\\S*)").alias("test")),
    )


def intent(raw: Column) -> Column:
    """Fields of an intent, braces inside it nested to any depth; of one that nothing closes, its balanced beginning."""
    rest = F.get(F.split(raw, "Intent ?\\{", 2), F.lit(1))
    inner = F.coalesce(F.left(rest, closed(rest, "{", "}")), F.regexp_extract(rest, "^((?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*)", 1))
    f = lambda k: extract(inner, f"\\b{k}=([^\\s}}]+)").alias(k)
    return F.when(raw.rlike("Intent ?\\{"), F.struct(f("act"), f("dat"), f("cmp")))


def http(raw: Column) -> Column:
    post = "flush=([0-9A-Fa-f-]+) post status=(\\d+)(?: retry=(\\d+))?(?: busy=(\\d+))?"
    done = "success=(\\d+) queued_before=(\\d+) synced=(\\d+) pages=(\\d+) duration_ms=(\\d+)"
    err = "(?m)HTTP ERROR: (\\d+)\\*?\\s*(.*)$"
    n = lambda p, i: F.nullif(F.regexp_extract(raw, p, i), F.lit("")).try_cast("bigint")
    status = F.coalesce(n(err, 1), n(post, 2), n("(?m)Response: (\\d+)\\s*$", 1))
    some = raw.rlike("HTTP Service \\(count: \\d+\\)|(?m)Response: \\d+\\s*$|HTTP POST: |" + post.split("(")[0] + "|queued_before=|HTTP ERROR: ")
    return F.when(
        some,
        F.struct(
            status.alias("status"), n("HTTP Service \\(count: (\\d+)\\)", 1).alias("count"), (n(done, 1) != 0).alias("success"), n(done, 2).alias("queued_before"), n(done, 3).alias("synced"),
            n(done, 4).alias("pages"), n(done, 5).alias("duration_ms"), n(post, 3).alias("retry"), n(post, 4).alias("busy"), extract(raw, post, 1).alias("flush"),
            F.when(raw.contains("HTTP ERROR:"), extract(raw, "(https?://[^\\s\"'>,;]+)")).alias("url"), F.nullif(F.trim(F.regexp_extract(raw, err, 2)), F.lit("")).alias("error"), extract(raw, "HTTP POST: ([0-9a-fA-F-]{8,})").alias("post_uuid"),
        ),
    )


def nserror(raw: Column) -> Column:
    p = "Error Domain=(\\S+) Code=(-?\\d+)(?: \\\\?\"(.*?)\\\\?\")?"
    said = F.coalesce(extract(raw, "UserInfo=\\{NSLocalizedDescription=([^}]*)"), F.nullif(F.nullif(F.regexp_extract(raw, p, 3), F.lit("(null)")), F.lit("")))
    return F.when(raw.contains("Error Domain="), F.struct(extract(raw, p, 1).alias("domain"), F.nullif(F.regexp_extract(raw, p, 2), F.lit("")).try_cast("bigint").alias("code"), said.alias("desc")))


def geofence(raw: Column) -> Column:
    a, e = "(?m)📢\\s*(\\w+) Geofence: (.+?)\\s*$", "Geofencing Event: (\\w+)"
    row = "(?m)^╟─\\s*([^:\\n]+?)\\s*$"
    after = F.regexp_extract(raw, f"(?s){e}(.*)$", 2)
    return F.when(raw.rlike(a), F.struct(F.regexp_extract(raw, a, 1).alias("action"), F.regexp_extract(raw, a, 2).alias("identifier"))).when(
        raw.contains("Geofencing Event:"), F.struct(F.regexp_extract(raw, e, 1).alias("action"), extract(after, row).alias("identifier"))
    )


def ab_compare(raw: Column) -> Column:
    """Rows of a comparison: label, text and position if it has one."""
    labels, texts = F.regexp_extract_all(raw, F.lit(_AB), F.lit(1)), F.regexp_extract_all(raw, F.lit(_AB), F.lit(2))
    pos = "(-?\\d+\\.\\d+)\\s*,\\s*(-?\\d+\\.\\d+)"
    rows = F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.get(texts, i).alias("raw"), _d(F.regexp_extract(F.get(texts, i), pos, 1)).alias("lat"), _d(F.regexp_extract(F.get(texts, i), pos, 2)).alias("lon")))
    return F.when(raw.rlike(_AB), rows)


def labelled_locations(raw: Column, locs: Column) -> Column:
    """'Stationary=Location[…]' and the like: label to position."""
    labels = F.regexp_extract_all(raw, F.lit("(\\w+)=Location\\["), F.lit(1))
    n = F.least(F.size(labels), F.size(locs))
    return F.when(n > 0, F.map_from_entries(F.transform(F.array_distinct(F.slice(labels, F.lit(1), n)), lambda k: F.struct(k, F.element_at(locs, F.array_position(labels, k).cast("int"))))))


# Configuration dumps ---------------------------------------------------------------------------------------------


def json_top_keys(text: str) -> tuple[dict, bool]:
    """Complete top-level keys of an indented JSON dump that can be cut anywhere, and whether it was cut."""
    out: dict = {}
    key, held, closed = None, [], False
    for line in text.split("\n"):
        if line.rstrip() == "}" and key is None:
            closed = True
            break
        m = re.match(r'  "((?:[^"\\]|\\.)*)": ?(.*)$', line)
        if m and key is None:
            value = m[2].rstrip()
            if value in ("{", "["):
                key, held = m[1], [value]
                continue
            _put(out, m[1], value)
        elif key is not None:
            held.append(line)
            if re.match(r"  [\]}],?\s*$", line):
                _put(out, key, "\n".join(held))
                key = None
    return out, not closed


def _put(out: dict, key: str, value: str) -> None:
    try:
        out[key] = json.loads(value.rstrip().rstrip(","))
    except ValueError:
        pass


class _Plist:
    """Old-style property list: { k = v; }, ( a, b ), {( … )}, strings, "<null>", numbers."""

    def __init__(self, text: str):
        self.s, self.i, self.cut = text, 0, False

    def _space(self):
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def value(self, depth: int = 0):
        self._space()
        if self.i >= len(self.s) or depth > 200:
            self.cut = True
            return None
        c = self.s[self.i]
        if self.s.startswith("{(", self.i):
            self.i += 1
            out = self._list(depth)
            self._space()
            self.i += self.s.startswith("}", self.i)
            return out
        if c == "{":
            return self._dict(depth)
        if c == "(":
            return self._list(depth)
        return self._scalar()

    def _dict(self, depth):
        out: dict = {}
        self.i += 1
        while True:
            self._space()
            if self.i >= len(self.s):
                self.cut = True
                return out
            if self.s[self.i] == "}":
                self.i += 1
                return out
            at = self.i
            key = self._scalar()
            self._space()
            if not self.s.startswith("=", self.i):
                self.cut = True
                if self.i == at:
                    self.i += 1
                continue
            self.i += 1
            v = self.value(depth + 1)
            if not self.cut:
                out[str(key)] = v
            self._space()
            self.i += self.s.startswith(";", self.i)

    def _list(self, depth):
        out = []
        self.i += 1
        while True:
            self._space()
            if self.i >= len(self.s):
                self.cut = True
                return out
            if self.s[self.i] == ")":
                self.i += 1
                return out
            at = self.i
            out.append(self.value(depth + 1))
            self._space()
            self.i += self.s.startswith(",", self.i)
            if self.i == at:
                self.i += 1

    def _scalar(self):
        if self.s.startswith('"', self.i):
            m = re.compile(r'"((?:[^"\\]|\\.)*)"').match(self.s, self.i)
            if not m:
                self.cut, self.i = True, len(self.s)
                return None
            self.i = m.end()
            t = m[1].replace('\\"', '"').replace("\\\\", "\\")
        else:
            m = re.compile(r"[^\s=;,(){}]+").match(self.s, self.i)
            if not m:
                self.i += 1
                return None
            self.i = m.end()
            t = m[0]
        if t == "<null>":
            return None
        for kind in (int, float):
            try:
                return kind(t)
            except ValueError:
                pass
        return t


def config_dump(raw: str) -> tuple[str | None, bool | None]:
    """(JSON text, truncated) of a record's dump, or nulls. Error dictionaries are not configurations."""
    at = re.search(r"(?m)^\s*\{\s*$|\{\s*\n", raw)
    if not at or "NSUnderlyingError" in raw or "Error Domain=" in raw:
        return None, None
    body = raw[raw.index("{", at.start()) :]
    if re.search(r'(?m)^  "[^"]+": ?', body):
        data, cut = json_top_keys(body)
    elif re.search(r"(?m)^\s+\"?[\w.]+\"? = ", body):
        p = _Plist(body)
        data, cut = p.value(), p.cut
    else:
        return None, None
    if not isinstance(data, dict) or not data:
        return None, None
    return json.dumps(data, ensure_ascii=False, allow_nan=False, default=str), cut


def _config(raw: pd.Series) -> pd.DataFrame:
    def one(x):
        try:
            return config_dump(x) if isinstance(x, str) else (None, None)
        except (ValueError, RecursionError):
            return None, None

    return pd.DataFrame([one(x) for x in raw], columns=["data", "truncated"])


def annotate(records: DataFrame) -> DataFrame:
    """``records`` with ``structs``. Only records that can hold a dump go through Python. Parsing is the costly part, so
    records are dealt evenly before it: windows leave whole captures in few tasks."""
    raw = F.col("raw")
    if "capture_id" in records.columns:
        records = records.repartition("capture_id", "seq")
    # what is used more than once is a column of its own, so that it is evaluated once
    d = records.withColumn("__bare", bare_text(raw)).withColumn("__locs", locations(F.col("__bare"))).withColumn("__filter", filter_map(raw))
    many = (F.size("__locs") > 1) | F.exists("__locs", lambda x: x["batch_index"].isNotNull())
    dump = raw.rlike("(?m)\\{\\s*$") & (raw.rlike('(?m)^  "[^"]+": ?') | raw.rlike('(?m)^\\s+"?[\\w.]+"? = '))
    cfg = F.pandas_udf(_config, "struct<data:string,truncated:boolean>")(F.when(dump, raw))
    structs = F.struct(
        F.get("__locs", F.lit(0)).alias("location"), F.when(many, F.col("__locs")).alias("locations"), filter_result(F.col("__filter")).alias("filter_result"), detected_activity(raw).alias("detected_activity"),
        motion_activity(raw).alias("motion_activity"), intent(raw).alias("intent"), F.when(dump & F.col("__cfg.data").isNotNull(), F.col("__cfg")).alias("config_dump"), http(raw).alias("http"), nserror(raw).alias("nserror"),
        geofence(raw).alias("geofence"), ab_compare(raw).alias("ab_compare"),
    )
    return d.withColumn("__cfg", cfg).withColumn("structs", structs).drop("__bare", "__locs", "__filter", "__cfg")
