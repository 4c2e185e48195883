"""Documents of all captures in one write: every section, table and layer as rows (capture_id, file, part, name, nth, body),
dealt by capture and sorted, and a Python data source whose tasks put them into files. The number of jobs does not depend on
the number of captures, and no row passes through the driver."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.shared import shared_dir, written
from . import pyramid, sinks

#: Files in the order in which a capture's rows come: its aliases are known before anything that they replace.
ALIASES, DIGEST, TABLES, MAP, GEOJSON = range(5)
NAMES = {ALIASES: "aliases.local.json", DIGEST: "digest.md", TABLES: "digest.json", MAP: "map.html", GEOJSON: "locations.geojson"}
#: Tables that one job gathers.
PARTS = 6
_COLUMNS = ["capture_id", "file", "part", "name", "nth", "body"]
SCHEMA = "capture_id string, file int, part int, name string, nth bigint, body string"


def _row(df: DataFrame, file: int, part, name, nth, body) -> DataFrame:
    return df.select("capture_id", F.lit(file).alias("file"), part.cast("int").alias("part"), name.alias("name"), nth.cast("bigint").alias("nth"), body.alias("body"))


def _json(df: DataFrame, columns: list[str]):
    kinds = dict(df.dtypes)
    cell = lambda c: (F.col(c).cast("string") if kinds[c].startswith(("timestamp", "date")) else F.col(c)).alias(c)
    return F.to_json(F.struct(*map(cell, columns)), {"ignoreNullFields": "false"})


def digest_rows(tables: dict[str, DataFrame]) -> list[DataFrame]:
    return [_row(t, DIGEST, F.lit(i), F.lit(sinks.SECTIONS[i].title), F.col("nth"), _json(t, sinks.SECTIONS[i].columns)) for i, t in sinks.section_rows(tables)]


def table_rows(tables: dict[str, DataFrame]) -> list[DataFrame]:
    given = [(k, v) for k, v in tables.items() if v is not None]
    return [_row(v, TABLES, F.lit(i), F.lit(k), F.lit(0), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) for i, (k, v) in enumerate(given)]


def feature_rows(features: DataFrame, file: int, shown: DataFrame | None = None) -> DataFrame:
    """Features, or those of ``shown``, of captures that are worth a map: those with a track or at least five fixes."""
    worth = features.groupBy("capture_id").agg(F.count_if(F.col("layer") == "track").alias("tracks"), F.count_if(F.col("layer") == "fixes").alias("fixes")).where("tracks > 0 or fixes >= 5")
    f = sinks.geojson(features if shown is None else shown).join(worth.select("capture_id"), "capture_id", "left_semi")
    return _row(f, file, F.lit(0), F.col("layer"), F.col("seq"), F.col("feature"))


def alias_rows(aliases: DataFrame) -> DataFrame:
    """The longest strings first, so that none is replaced inside another."""
    return _row(aliases, ALIASES, F.lit(0), F.lit(""), -F.length("raw"), F.to_json(F.struct("raw", "alias")))


def write(tables: dict[str, DataFrame], features: DataFrame, aliases: DataFrame | None, path: str, page: bool = True, locations: bool = False) -> None:
    """All documents under ``path``, a folder per capture; it has to be one that all executors write to."""
    parts = [*digest_rows(tables), *table_rows(tables)]
    if page:
        features = written(features, "features")
    parts += [alias_rows(aliases)] if aliases is not None else []
    parts += [feature_rows(features, MAP), feature_rows(features, MAP, pyramid.of_features(features))] if page else []
    parts += [feature_rows(features, GEOJSON)] if page and locations else []
    # some parts at a time, as one plan of all would be too large to optimise
    spark = features.sparkSession
    at = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    for i in range(0, len(parts), PARTS):
        reduce(DataFrame.unionByName, parts[i : i + PARTS]).write.mode("append").parquet(at)
    rows = spark.read.schema(SCHEMA).parquet(at)
    spark.dataSource.register(Documents)
    dealt = rows.repartition("capture_id").sortWithinPartitions(*_COLUMNS)
    names = json.dumps([k for k, v in tables.items() if v is not None])
    dealt.write.format("trailmill_documents").mode("append").option("path", path).option("tables", names).save()


class Documents(DataSource):
    """Sink of rows (capture_id, file, part, name, nth, body), whole captures in order."""

    @classmethod
    def name(cls) -> str:
        return "trailmill_documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options.get("tables", "[]")))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, tables: list[str]):
        self.path, self.tables = path, tables

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for capture, mine in groupby(rows, key=lambda r: r.capture_id):
            aliases: dict[str, str] = {}
            for file, part in groupby(mine, key=lambda r: r.file):
                if file == ALIASES:
                    aliases = {x["raw"]: x["alias"] for x in (json.loads(r.body) for r in part)}
                    text = iter([json.dumps({v: k for k, v in aliases.items()}, ensure_ascii=False, indent=1, sort_keys=True)])
                else:
                    text = {DIGEST: self._digest, TABLES: self._tables, MAP: self._map, GEOJSON: self._layers}[file](capture, part, aliases)
                _put(f"{self.path}/{capture}/{NAMES[file]}", text)
        return WriterCommitMessage()

    def _digest(self, capture, rows, aliases):
        by = {i: [(r.nth, json.loads(r.body)) for r in g] for i, g in groupby(rows, key=lambda r: r.part)}
        text = sinks.digest_text(capture, self.tables, by)
        if aliases:
            whole = re.compile("(?<![\\w.])(?:" + "|".join(map(re.escape, aliases)) + ")(?!\\w)")
            text = whole.sub(lambda hit: aliases[hit[0]], text)
        yield text

    def _tables(self, capture, rows, aliases):
        yield "{"
        left = list(self.tables)
        first = True
        for name, g in groupby(rows, key=lambda r: r.name):
            left.remove(name)
            yield from self._list(name, (r.body for r in g), first)
            first = False
        for name in left:
            yield from self._list(name, iter(()), first)
            first = False
        yield "}\n"

    @staticmethod
    def _list(name, bodies, first):
        yield ("" if first else ",\n") + json.dumps(name) + ": ["
        for i, b in enumerate(bodies):
            yield ("" if i == 0 else ",\n ") + b
        yield "]"

    @staticmethod
    def _layers(capture, rows, aliases):
        yield "{"
        for n, (layer, g) in enumerate(groupby(rows, key=lambda r: r.name)):
            yield ("," if n else "") + json.dumps(layer) + ':{"type":"FeatureCollection","features":['
            for i, r in enumerate(g):
                yield ("," if i else "") + r.body
            yield "]}"
        yield "}"

    def _map(self, capture, rows, aliases):
        head, tail = sinks.page_parts(capture)
        yield head
        yield from (x.replace("</", "<\\/") for x in self._layers(capture, rows, aliases))
        yield tail


def _put(path: str, chunks: Iterator[str]) -> None:
    """Write under a name of its own, then rename: a task that runs again replaces the file by the same."""
    from pyarrow import fs

    there, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    there.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    with there.open_output_stream(own) as f:
        for c in chunks:
            f.write(c.encode("utf-8", "surrogatepass"))
    there.move(own, at)
