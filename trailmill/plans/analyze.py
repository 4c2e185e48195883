"""The whole analysis of captures, and a slice around a moment."""

from __future__ import annotations

import argparse
import os
import re
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import captures as C
from ..sources import payloads as P
from ..sources import records as R
from ..operators import sequence as S
from ..operators.shared import written
from . import findings as N
from . import layers as L
from . import enrich as E
from . import redact, report, router, sinks
from .vocabulary import Entry, Meanings, classify, harvest_versions, interpret, load_entries, load_meanings, load_sources, overlay

VERSION = "0.1.0"


@dataclass
class Analysis:
    captures: DataFrame
    records: DataFrame
    tables: dict[str, DataFrame]
    features: DataFrame


def prepare(captures: DataFrame, large: bool = False) -> DataFrame:
    """Annotated records with marks, segments and app state; ``large`` deals captures in segments."""
    m = N.marks(P.annotate(R.assemble(captures, large)))
    return N.with_state(N.with_segments(m))


def analyze(spark: SparkSession, paths: list[str], year: int | None = None, entries: list[Entry] | None = None, excerpt: bool = False, heartbeat_s: float | None = None, rules: router.Rules | None = None, builds: dict[str, str] | None = None, meanings: Meanings | None = None, large_bytes: int = 64 << 20, harvested: dict[str, str] | None = None) -> Analysis:
    """All findings of all captures as tables. Records, silences and classified records, which many tables share, are written
    to the shared folder; nothing else runs until a table is used. ``rules`` place and leave out markers; ``builds`` names the
    versions of build numbers; ``meanings`` gives classified records categories and meanings of icons; ``harvested`` says of each platform at which release the lines of sources were taken. If a file has more than
    ``large_bytes``, captures are dealt in segments, so that none of them is one task."""
    found = C.read_captures(spark, paths, year)
    dup = C.duplicates(found.where("kind = 'text'").select("path", "text"), "path", "text")
    found = found.join(dup, "path", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    m = prepare(found.where("not duplicate and kind = 'text' and platform <> 'unknown'"), C.largest_bytes(spark, paths) > large_bytes)
    # a table in the shared folder: its readers take the columns they need, and plans begin anew behind it
    m = written(m, "records")
    seg, gap = N.segments(m), written(N.gaps(m), "gaps")
    cov = unk = kinds = None
    if entries:
        versioned = m.join(seg.select("capture_id", "segment", F.col("version").alias("v")), ["capture_id", "segment"], "left")
        k = classify(versioned.select("capture_id", "seq", "platform", "raw", "tag_class", "tag_method", "level", "icon", X.resolve_version(F.col("v"), builds or {}).alias("version")), entries)
        k = written(interpret(k, meanings or Meanings()), "classified")
        cov, unk = N.coverage(k), N.unknown_examples(k)
        kinds = k.groupBy("capture_id", "category", k.klass.semantic.alias("semantic"), k.klass.family.alias("family")).agg(F.count("*").alias("n"))
    h, cfg, groups = N.header(m), N.config(m), N.dedup(m, k if entries else None)
    tables = {
        "header": h, "config": cfg, "segments": seg, "gaps": gap, "lane": S.lane_intervals(m, ["capture_id"], "seq", "ts"), "dedup": groups, "pairs": N.pairs(m), "parity": N.parity(m, cfg),
        "http": N.http_health(m), "status": N.status_histogram(m), "connectivity": N.connectivity(m), "urls": N.url_report(m), "geofence": N.geofence_health(m), "motion": N.motion_health(m, cfg=cfg),
        "activity": N.activity_histogram(m), "power": N.power_events(m), "heartbeats": N.heartbeats(m, heartbeat_s, cfg), "duty": N.duty_cycle(m, gap), "auth": N.auth_timeline(m), "end_state": N.end_state(m),
        "coverage": cov, "unknown": unk, "categories": kinds, "anomalies": N.anomalies(m, gap, cov, heartbeat_s, excerpt, cfg), "missing": N.missing_evidence(h, cfg, seg), "sessions": L.sessions(L.fixes(m), gap, m),
    }
    tables |= {
        "launches": E.launches(m), "fence_evidence": E.fence_evidence(m), "deliveries": E.event_pairs(m), "upload_outcomes": E.upload_outcomes(m), "notable_config": E.notable_config(cfg),
        "log_level": E.effective_level(cfg, m), "opening": E.opening_window(m, tables["sessions"]),
    }
    if entries and harvested:
        tables["source_notes"] = N.source_notes(groups, h, harvested)
    tables["layer_counts"] = router.window_counts(L.placed_events(m, L.fixes(m), rules), tables["opening"])
    return Analysis(found, m, tables, L.features(m, gap, rules))


_SPEC = re.compile(r"^(?P<ts>.+?)±(?P<n>\d+)(?P<unit>[sm]?)$")


def slice_records(records: DataFrame, spec: str) -> DataFrame:
    """Records within '<time>±N[s|m]' of a moment, bounds included. A time without a year takes the first record's; a
    time that isn't complete is a prefix, and the window lies around its first record."""
    m = _SPEC.match(spec.strip())
    if not m:
        raise ValueError(f"not a slice: {spec!r}; write <time>±N[s|m]")
    seconds = int(m["n"]) * (60 if m["unit"] == "m" else 1)
    text = m["ts"].strip().replace("T", " ")
    first = records.where(F.col("ts").isNotNull()).orderBy("capture_id", "seq").select("ts").limit(1).collect()
    if re.match(r"^\d{2}-\d{2} ", text) and first:
        text = f"{first[0].ts.year}-{text}"
    full = re.match(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$", text)
    if full:
        center = F.lit(text).cast("timestamp_ntz")
    else:
        hit = records.where(F.col("ts_raw").startswith(m["ts"].strip()) | F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").startswith(text)).where(F.col("ts").isNotNull()).orderBy("capture_id", "seq").select("ts").limit(1).collect()
        if not hit:
            raise ValueError(f"no record at {m['ts']!r}")
        center = F.lit(hit[0].ts).cast("timestamp_ntz")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return records.where(F.abs(us(F.col("ts")) - us(center)) <= seconds * 1_000_000)


def registered(records: DataFrame) -> DataFrame:
    """Fence identifiers that payloads name, to be aliased wherever they occur."""
    g = records.where(F.col("structs.geofence.identifier").isNotNull())
    return g.select("capture_id", F.lit("gf").alias("kind"), F.col("structs.geofence.identifier").alias("value")).distinct()


def redacted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with ``redacted`` text, and the alias table."""
    t = redact.alias_table(records, ["capture_id"], ["seq"], "raw", registered(records))
    return redact.apply_aliases(records, t, ["capture_id"], "raw"), t


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trailmill", description="Analyze log captures.")
    p.add_argument("files", nargs="+")
    p.add_argument("--out", default="out")
    p.add_argument("--map", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--locations", action="store_true", help="write locations.geojson too")
    p.add_argument("--slice", help="print the records around a time: '<time>±N[s|m]'")
    p.add_argument("--redact", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--year", type=int)
    p.add_argument("--vocabulary", action="append", default=[], metavar="PLATFORM=FILE")
    p.add_argument("--sources", action="append", default=[], metavar="PLATFORM=FILE", help="file with the source lines of a vocabulary's entries")
    p.add_argument("--meanings", help="file with categories, hints and meanings of icons")
    p.add_argument("--rules", help="file with rules for the map's layers")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("trailmill").getOrCreate()
    if spark.conf.get("spark.sql.shuffle.partitions") == "200":  # the default: a partition for each 16 MB instead
        spark.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-C.total_bytes(spark, a.files) // (16 << 20)))))
    entries: list[Entry] = []
    harvested: dict[str, str] = {}
    for v in a.vocabulary:
        platform, _, path = v.partition("=")
        more, warnings = load_entries(path, platform)
        entries += more
        harvested |= harvest_versions(path, platform)
        for w in warnings:
            print(w, file=sys.stderr)
    for v in a.sources:
        platform, _, path = v.partition("=")
        lines, warnings = load_sources(path)
        overlay([e for e in entries if e.platform == platform], lines)
        for w in warnings:
            print(w, file=sys.stderr)
    if a.slice:
        c = C.read_captures(spark, a.files, a.year)
        r = slice_records(P.annotate(R.assemble(c)), a.slice)
        rows = (redacted(r)[0].select("seq", F.col("redacted").alias("x")) if a.redact else r.select("seq", F.col("raw").alias("x"))).orderBy("capture_id", "seq")
        n = 0
        for row in rows.toLocalIterator():
            print(row.x)
            n += 1
        return 0 if n else 1
    rules, warnings = router.load_rules(a.rules)
    for w in warnings:
        print(w, file=sys.stderr)
    meanings, warnings = load_meanings(a.meanings) if a.meanings else (None, [])
    for w in warnings:
        print(w, file=sys.stderr)
    res = analyze(spark, a.files, a.year, entries or None, rules=rules, meanings=meanings, harvested=harvested)
    made = sinks.output_dir(a.out)
    aliases = redacted(res.records)[1] if a.redact else None
    report.write(res.tables, res.features, aliases, a.out, a.map, a.locations)
    n = res.tables["header"].count()
    print(f"{n} captures in {a.out}" + (" (new, ignored by git)" if made else "") + "; aliases.local.json and digest.json (not redacted) are not for sharing", file=sys.stderr)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
