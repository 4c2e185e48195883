"""Message vocabulary: entries that say which log site wrote a record.

Entries (id, class, method, level, icon, patterns, anchor, valid_from, valid_to, flags, semantic, family) are data,
loaded from YAML or JSON. From each pattern's parse tree come its literal fragments; an automaton over the anchors
proposes entries for a record, and their patterns decide on its text as it is. Entries without an anchor are catch-alls,
which only decide where no other entry does. All of it runs in Arrow batches with the vocabulary broadcast; its size is
checked against ``MAX_ENTRIES``. Meanings (category, hints, icons) are column expressions over the result.

Ties break on the position in the vocabulary."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.shared import written

MAX_ENTRIES = 200_000
MIN_ANCHOR = 4
DRIFT_SHARE, DRIFT_TOKENS = 0.60, 3
CATCHALL_TIES, CATCHALL_SITES = 3, 6
_EMOJI = re.compile("[\U0001f000-\U0001faff⌀-⏿☀-➿⬀-⯿‼⁉]")
_SELECTORS = str.maketrans("", "", "︎️")
_WORD = re.compile(r"[A-Za-z0-9_]{3,}")
_METHOD_TAIL = re.compile(r"(?:_block_invoke(?:_?\d+)?|\[λ\]|\$\d+)$")

# Tags of the logging layer itself, and tags of bodies that applications write.
HELPER_TAGS = ("TSLog", "Logger", "LoggerFacade", "LoggerFacade$Entry")
BRIDGE_TAGS = {"ios": ("TSLocationManager", "log"), "android": ("Logger", "")}


@dataclass
class Entry:
    id: str
    platform: str
    cls: str | None = None
    method: str | None = None
    level: str | None = None
    icon: str | None = None
    patterns: list[str] = field(default_factory=list)
    anchor: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    flags: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    semantic: str | None = None
    family: str | None = None


def version_key(v: str | None) -> tuple[int, ...] | None:
    """Four numbers of a version, without what follows in parentheses; None where there is none."""
    numbers = re.findall(r"\d+", str(v).partition("(")[0]) if v is not None else []
    return tuple(([int(x) for x in numbers] + [0] * 4)[:4]) if numbers else None


def newest_version(versions: list[str]) -> str | None:
    known = [v for v in versions if v.upper() != "HEAD" and version_key(v)]
    return max(known, key=version_key, default=None)


def fragments(pattern: str) -> list[tuple[str, bool]]:
    """Literal runs of a pattern, and whether each occurs in every match."""
    from re import _parser as tree  # the standard library's own parser

    out: list[tuple[str, bool]] = []

    def walk(items, safe: bool) -> None:
        run: list[str] = []

        def close():
            if run:
                out.append(("".join(run), safe))
                run.clear()

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
                continue
            if name == "AT":
                close()
                continue
            close()
            if name == "SUBPATTERN":
                walk(arg[3], safe)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                walk(arg[2], safe and arg[0] > 0)
            elif name == "BRANCH":
                for b in arg[1]:
                    walk(b, False)
            elif name in ("ASSERT", "ASSERT_NOT"):
                walk(arg[1], False)
            elif name == "ATOMIC_GROUP":
                walk(arg, safe)
        close()

    try:
        walk(tree.parse(pattern, re.M | re.S), True)
    except re.error:
        return []
    return out


def qualifies(text: str | None) -> bool:
    return bool(text) and (len(text.strip()) >= MIN_ANCHOR or bool(_EMOJI.search(text)))


def _data(path: str) -> tuple[object, list[str]]:
    """What a JSON or YAML file holds, and warnings; None for a missing or invalid one."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return json.loads(text), []
        import yaml

        return yaml.safe_load(text), []
    except Exception as e:  # a YAML error has no common base with the others
        return None, [f"{path}: {e}"]


def harvest_versions(path: str, platform: str) -> dict[str, str]:
    """{platform: newest release that the file's entries were taken from}, as its ``meta`` says; empty if it doesn't."""
    data, _ = _data(path)
    meta = data.get("meta") if isinstance(data, dict) else None
    refs = meta.get("harvested_refs") if isinstance(meta, dict) else None
    newest = newest_version([str(x) for x in refs]) if isinstance(refs, (dict, list)) else None
    return {str(meta.get("platform") or platform): newest} if newest else {}


def load_sources(path: str) -> tuple[dict[str, list[str]], list[str]]:
    """{entry id: source references} of a file, and warnings."""
    data, warnings = _data(path)
    found = data.get("sources") if isinstance(data, dict) else None
    if not isinstance(found, dict):
        return {}, warnings or [f"{path}: no sources"]
    return {str(k): [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in found.items() if v}, warnings


def load_entries(path: str, platform: str) -> tuple[list[Entry], list[str]]:
    """Entries and warnings; a missing or invalid file gives none and says so."""
    data, warnings = _data(path)
    if warnings:
        return [], warnings
    rows = data.get("entries", []) if isinstance(data, dict) else data or []
    out, warn = [], []
    for r in rows:
        if not isinstance(r, dict) or "id" not in r:
            warn.append(f"{path}: an entry without id")
            continue
        r = {("cls" if k == "class" else k): v for k, v in r.items()}
        known = {k: v for k, v in r.items() if k in Entry.__dataclass_fields__}
        known = {k: v for k, v in known.items() if v is not None}
        if "method" in known:
            known["method"] = _METHOD_TAIL.sub("", known["method"])
        out.append(Entry(**{"platform": platform, **known}))
    return out, warn


def overlay(entries: list[Entry], sources: dict[str, list[str]]) -> None:
    """Attach source references by id."""
    for e in entries:
        e.source = list(sources.get(e.id, e.source))


class Site:
    """An entry made ready: compiled patterns, automaton keys, length of the longest literal, words, valid versions."""

    def __init__(self, e: Entry):
        self.entry = e
        self.patterns = []
        self.keys: set[str] = set()
        self.words = set(_WORD.findall(e.anchor or ""))
        self.low, self.high = version_key(e.valid_from), version_key(e.valid_to)
        lengths = [0]
        for p in e.patterns:
            try:
                self.patterns.append(re.compile(p, re.M | re.S))
            except re.error:
                continue
            parts = fragments(p)
            self.words.update(w for text, _ in parts for w in _WORD.findall(text))
            sure = [text for text, ok in parts if ok]
            lengths += [len(t.strip()) for t in sure]
            longest = max(sure, key=len, default="").strip("\n")
            if qualifies(longest):
                self.keys.add(longest.translate(_SELECTORS))
        if qualifies(e.anchor):
            self.keys.add(e.anchor.translate(_SELECTORS))
            lengths.append(len(e.anchor.strip()))
        self.length = max(lengths)
        self.passing = "passthrough" in e.flags
        self.loose = not self.passing and ("builder-catchall" in e.flags or not self.keys)

    def valid(self, v: tuple | None) -> bool:
        return v is None or ((self.low is None or self.low <= v) and (self.high is None or v <= self.high))

    def matches(self, raw: str) -> bool:
        return any(p.search(raw) for p in self.patterns)

    def agreement(self, level, icon) -> tuple[bool, bool]:
        e = self.entry
        return bool(e.level) and e.level == level, bool(e.icon) and e.icon == icon


class Matcher:
    """Decides for one record at a time; made once per worker."""

    def __init__(self, entries: list[Entry]):
        import ahocorasick

        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"{len(entries)} entries; at most {MAX_ENTRIES} are broadcast")
        self.sites = [Site(e) for e in entries]
        self.at: dict[tuple, list[int]] = {}  # (platform, passing, class[, method])
        self.loose: dict[str, list[int]] = {}
        keys: dict[str, dict[str, list[int]]] = {}
        for i, s in enumerate(self.sites):
            e = s.entry
            where = (e.platform, s.passing, e.cls or "")
            for k in (where, (*where, e.method or "")):
                self.at.setdefault(k, []).append(i)
            if s.loose:
                self.loose.setdefault(e.platform, []).append(i)
            elif not s.passing:
                for k in s.keys:
                    keys.setdefault(e.platform, {}).setdefault(k, []).append(i)
        self.automata = {}
        for platform, table in keys.items():
            a = self.automata[platform] = ahocorasick.Automaton()
            for k, ids in table.items():
                a.add_word(k, ids)
            a.make_automaton()
        self.versions: dict[str | None, tuple | None] = {}

    def classify(self, r: dict) -> dict:
        """status, sites, confidence, semantic, family, drift_of, cls, method of a record with platform, raw, tag_class,
        tag_method, level, icon, version."""
        platform, raw, cls, method = r["platform"], r["raw"], r["tag_class"] or "", r["tag_method"] or ""
        version = r["version"]
        if version not in self.versions:
            if len(self.versions) > 10_000:
                self.versions.clear()
            self.versions[version] = version_key(version)
        v = self.versions[version]
        S, helper = self.sites, is_helper(cls)
        here = (platform, True, cls)
        for i in self.at.get((*here, method)) or self.at.get(here, ()):
            if S[i].valid(v):
                return _answer("passthrough", "exact", [S[i].entry], S[i].entry.source)
        tag, begin = BRIDGE_TAGS.get(platform, ("", ""))
        if tag and cls == tag and method.startswith(begin):
            return _answer("passthrough", "exact", [], [])

        a = self.automata.get(platform)
        found = sorted({i for _, ids in a.iter(raw.translate(_SELECTORS)) for i in ids}) if a is not None else []
        found = [i for i in found if S[i].valid(v)]
        here = (platform, False, cls)
        near = []  # entries of the record's own tag
        if cls and platform == "ios":
            near = [i for i in self.at.get((*here, method), ()) if S[i].valid(v)]
        if cls and not near and (platform == "ios" or not helper):
            near = [i for i in self.at.get(here, ()) if S[i].valid(v)]

        def tell(i: int) -> tuple[int, int, int]:
            e = S[i].entry
            own = 0 if not cls or helper or e.cls != cls else 2 if e.method and e.method == method else 1
            return S[i].length, own, sum(S[i].agreement(r["level"], r["icon"]))

        def best(pool, loose: bool) -> tuple[list[int], int]:
            """The best of the pool's entries that match, and how many match."""
            good = [i for i in pool if S[i].loose == loose and S[i].matches(raw)]
            ranks = [tell(i) for i in good]
            top = max(ranks, default=None)
            return [i for i, x in zip(good, ranks) if x == top], len(good)

        group: list[int] = []
        if platform == "ios":
            group = best(near, False)[0] or best(found, False)[0]
            if not group:
                last, n = best(near, True)
                group = last if n <= CATCHALL_TIES else []
        else:
            group = best(found, False)[0]
            if not group:
                if cls and not helper:
                    pool = [i for i in near if any(S[i].agreement(r["level"], r["icon"])) or not (S[i].entry.level or S[i].entry.icon)]
                else:
                    pool = [i for i in self.loose.get(platform, ()) if S[i].valid(v) and all(S[i].agreement(r["level"], r["icon"]))]
                last, _ = best(pool, True)
                if len(last) <= CATCHALL_TIES and len({x for i in last for x in S[i].entry.source}) <= CATCHALL_SITES:
                    group = last
        if group:
            es = [S[i].entry for i in group]
            return _answer("matched", "exact" if len(es) == 1 else "ambiguous", es, list(dict.fromkeys(x for e in es for x in e.source)) or [es[0].id])
        pool = sorted({*near, *found})
        if pool:
            words, share, at = set(_WORD.findall(raw)), 0.0, None
            for i in pool:
                w = S[i].words
                if len(w) >= DRIFT_TOKENS and (x := len(w & words) / len(w)) >= DRIFT_SHARE and x > share:
                    share, at = x, S[i].entry
            if at is not None:
                return {**_answer("drift", "fuzzy", [at], at.source), "drift_of": at.id}
        return _answer("unknown", None, [], [])


def _answer(status: str, confidence: str | None, entries: list[Entry], sites: list[str]) -> dict:
    first = entries[0] if entries else None
    same = lambda name: (getattr(first, name) or None) if len({getattr(e, name) for e in entries}) == 1 else None
    return {
        "status": status, "sites": list(sites), "confidence": confidence, "semantic": same("semantic"), "family": same("family"), "drift_of": None,
        "cls": first.cls if first else None, "method": first.method if first else None,
    }


def is_helper(cls: str | None) -> bool:
    """Tags of the logging layer, which say nothing about the site."""
    return bool(cls) and (cls in HELPER_TAGS or cls.startswith("LoggerFacade") or cls.endswith("$Entry"))


KLASS = "struct<status:string,sites:array<string>,confidence:string,semantic:string,family:string,drift_of:string,cls:string,method:string>"
_TYPE = pa.struct([("status", pa.string()), ("sites", pa.list_(pa.string())), *((n, pa.string()) for n in ("confidence", "semantic", "family", "drift_of", "cls", "method"))])
_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, entries: list[Entry]) -> Matcher:
    """The worker's matcher of a vocabulary, by the digest of its entries; a few are kept."""
    if key not in _MATCHERS:
        while len(_MATCHERS) >= 4:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[key] = Matcher(entries)
    return _MATCHERS[key]


def classify(records: DataFrame, entries: list[Entry], version: str = "version") -> DataFrame:
    """``records`` with ``klass``; needs platform, raw, tag_class, tag_method, level, icon and a version column."""
    spark: SparkSession = records.sparkSession
    shared = spark.sparkContext.broadcast(entries)
    key = hashlib.sha256(repr(entries).encode()).hexdigest()
    needed = ["platform", "raw", "tag_class", "tag_method", "level", "icon"]
    at = {c: records.columns.index(c) for c in needed} | {"version": records.columns.index(version)}
    unknown = _answer("unknown", None, [], [])

    def run(batches):
        m = _matcher(key, shared.value)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in at.values()]
            rows = [m.classify(dict(zip(at, r))) if r[1] is not None else unknown for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _TYPE)], names=[*b.schema.names, "klass"])

    schema = records.select("*", F.lit(None).cast(KLASS).alias("klass")).schema
    return records.mapInArrow(run, schema)


def candidates(texts: DataFrame, key: str, text: str, literals: list[tuple[int, str]]) -> DataFrame:
    """(key, literal): which of the broadcast literals a text holds, by automaton, in one pass over the texts."""
    if len(literals) > MAX_ENTRIES:
        raise ValueError(f"{len(literals)} literals; at most {MAX_ENTRIES} are broadcast")
    shared = texts.sparkSession.sparkContext.broadcast(literals)

    def run(batches):
        import ahocorasick

        a = ahocorasick.Automaton()
        table: dict[str, list[int]] = {}
        for i, s in shared.value:
            if s:
                table.setdefault(s, []).append(i)
        for s, ids in table.items():
            a.add_word(s, ids)
        a.make_automaton()
        for b in batches:
            ks, ls = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                for i in sorted({i for _, ids in a.iter(t) for i in ids}) if t and table else ():
                    ks.append(k)
                    ls.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ls, pa.int64())], names=["key", "literal"])

    src = texts.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"key {src.dtypes[0][1]}, literal bigint")


def token_share(texts: DataFrame, key: str, text: str, entries: DataFrame, share: float = DRIFT_SHARE, least: int = DRIFT_TOKENS, broadcast_rows: int = 200_000) -> DataFrame:
    """(key, literal, share): entries (literal, s) of at least ``least`` distinct words, of which a text holds at least
    that share; words as the matcher's.

    A prefix-filtered overlap join: a text that lacks the rarest words of an entry, one more than it may lack, cannot hold
    enough of it. So texts and entries meet by those words only, ordered by how many texts hold them, and pairs that meet
    are verified on whole word sets. Words that most texts hold join nothing, unless an entry has no rarer ones."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_WORD.pattern), F.lit(0)))
    near = lambda d: F.broadcast(d) if d.limit(broadcast_rows + 1).count() <= broadcast_rows else d
    e = entries.select("literal", words(F.col("s")).alias("own")).withColumn("total", F.size("own")).where(F.col("total") >= least)
    # the least number of words that makes the share, found with the same division as the share itself
    enough = F.element_at(F.filter(F.sequence(F.lit(1), F.col("total")), lambda n: n / F.col("total") >= share), 1)
    each = written(e.withColumn("need", enough).select("literal", "total", "need", F.explode("own").alias("word")), "entries")
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words")).select("row", "key", F.explode("words").alias("word"))
    said = written(rows.join(near(each.select("word").distinct()), "word"), "words")
    seen = said.groupBy("word").agg(F.count("*").alias("texts"))
    rarest = F.row_number().over(Window.partitionBy("literal").orderBy(F.coalesce("texts", F.lit(0)), "word"))
    prefix = each.join(seen, "word", "left").withColumn("nth", rarest).where(F.col("nth") <= F.col("total") - F.col("need") + 1)
    prefix = written(prefix.select("word", "literal"), "prefixes")
    pairs = written(said.join(near(prefix), "word").select("row", "literal").distinct(), "pairs")
    held = said.join(near(pairs), "row").join(near(each.select("literal", "word", "total")), ["literal", "word"])
    out = held.groupBy("row", "literal").agg(F.first("key").alias("key"), (F.count("*") / F.first("total")).alias("share"))
    return out.where(F.col("share") >= share).select("key", "literal", "share")


def category(rules: list[dict], cls, method, hints, semantic):
    """Category of the first rule that holds. What decides a rule is its class pattern (at the begin of 'class.method'),
    else its hint (one of ``hints``), else its pattern of the meaning."""
    site = F.concat(F.coalesce(cls, F.lit("")), F.lit("."), F.coalesce(method, F.lit("")))
    chain = []
    for r in rules:
        if r.get("match_class"):
            cond = site.rlike(f"^(?:{r['match_class']})")
        elif r.get("match_body_hint"):
            cond = F.array_contains(hints, r["match_body_hint"])
        elif r.get("match_semantic"):
            cond = semantic.rlike(f"^(?:{r['match_semantic']})")
        else:
            continue
        chain.append(F.when(cond, r["category"]))
    return F.coalesce(*chain, F.lit(None).cast("string"))


def icon_meaning(rules: list[dict], platform, icon, version):
    """Meaning (semantic, family) of an icon by platform and version range: of the whole icon, else of its first character."""
    from ..functions.exprs import version_in

    def chain(c):
        out = []
        for r in rules:
            ok = (platform == r["platform"]) & (c == r["icon"].translate(_SELECTORS).strip())
            ok = ok & version_in(version, F.lit(r.get("valid_from")).cast("string"), F.lit(r.get("valid_to")).cast("string"))
            out.append(F.when(ok, F.struct(F.lit(r.get("semantic")).cast("string").alias("semantic"), F.lit(r.get("family")).cast("string").alias("family"))))
        return out

    return F.coalesce(*chain(icon), *chain(F.left(icon, F.lit(1))), F.lit(None).cast("struct<semantic:string,family:string>"))


def body_hints(hints: dict[str, str], raw):
    """Names of all hint emoji that a record holds, in the hints' order."""
    plain = F.regexp_replace(raw, "[\ufe0e\ufe0f]", "")
    found = [F.when(plain.contains(k.translate(_SELECTORS)), v) for k, v in hints.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


@dataclass
class Meanings:
    """What icons, emoji in bodies and tags mean: rules, in order."""

    categories: list[dict] = field(default_factory=list)
    hints: dict[str, str] = field(default_factory=dict)
    icons: list[dict] = field(default_factory=list)


def load_meanings(path: str) -> tuple[Meanings, list[str]]:
    """Meanings and warnings of a YAML or JSON file with categories, body_emoji_hints and icon_semantics by platform."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}  # JSON is YAML
    except Exception as e:  # a missing or invalid file gives no rules and says so
        return Meanings(), [f"{path}: {e}"]
    warn, good = [], []
    for r in data.get("categories") or []:
        try:
            if not isinstance(r, dict) or "category" not in r:
                raise ValueError("no category")
            for k in ("match_class", "match_semantic"):
                re.compile(str(r.get(k) or ""))
            good.append(r)
        except (ValueError, re.error) as e:
            warn.append(f"{path}: rule {r!r} left out: {e}")
    icons = [{**r, "platform": p} for p, rs in (data.get("icon_semantics") or {}).items() for r in rs or [] if isinstance(r, dict) and "icon" in r]
    return Meanings(good, {str(k): str(v) for k, v in (data.get("body_emoji_hints") or {}).items()}, icons), warn


def interpret(classified: DataFrame, m: Meanings, version: str = "version") -> DataFrame:
    """``classified`` with ``category``, and icons' meanings where ``klass`` has none. The matched entry's class and method
    stand for a tag that is missing or of the logging layer."""
    k, tag = F.col("klass"), F.coalesce("tag_class", F.lit(""))
    plumbing = (tag == "") | tag.isin(*HELPER_TAGS) | tag.startswith("LoggerFacade") | tag.endswith("$Entry")
    stand_in = plumbing & k["status"].isin("matched", "drift", "passthrough") & k["cls"].isNotNull()
    cls, method = F.when(stand_in, k["cls"]).otherwise(F.col("tag_class")), F.when(stand_in, k["method"]).otherwise(F.col("tag_method"))
    icon = icon_meaning(m.icons, F.col("platform"), F.col("icon"), F.col(version))
    out = classified.withColumn("category", category(m.categories, cls, method, body_hints(m.hints, F.col("raw")), k["semantic"]))
    filled = k.withField("semantic", F.coalesce(k["semantic"], icon["semantic"])).withField("family", F.coalesce(k["family"], icon["family"]))
    return out.withColumn("klass", filled)
