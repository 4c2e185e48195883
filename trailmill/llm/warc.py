"""Legacy archive converter: ARC version 1 and 2 to WARC.

An ARC file opens with a ``filedesc`` record that names its version and its header fields; each record is a header
line with these fields, the last of which declares the body's length, and the body. The converter makes equivalent
WARC records: a record id derived from URL, date and digest, an ISO timestamp from the 14-digit date, digests of
payload and block, and the type: ``warcinfo`` for ``filedesc``, ``response`` for an HTTP answer, ``resource`` else.
Records whose payload was seen become ``revisit`` records (profile identical-payload-digest) that keep the HTTP
header and name the response. Archives are gzip members, one per record, so that single records can be read.

The query writes pages to ARC archives of bounded size, indexes them, decides the types from the index (the payloads
are not shuffled) and converts each archive in one task; then it reads the WARC archives back.

Defined cases: a null html is an empty payload and a null url is ``about:blank``; rows with a null page_id are
responses that no other row refers to, unless their payload belongs to a page with an id; equal rows are all responses
if theirs is the smallest page_id of the payload; an empty table gives an empty result. A record cut short by the
end of its archive is kept with ``WARC-Truncated: length``; a header line that can't be read ends the archive with
ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path
from .storage import read_file, write_file

#: Fixed values of the formats: header fields by ARC version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Bytes that a decompressor gets at once.
PIECE = 4096
ROW = "X-Source-Row"
ROW_OF = "WARC-X-Refers-To-Row"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace for URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def gunzip(data: bytes):
    """Yield (offset, content) of each gzip member; plain data is one."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts, end = zlib.decompressobj(31), [], at
        # a little at a time: what is left over behind a member is copied
        while not d.eof and end < len(data):
            parts.append(d.decompress(view[end : end + PIECE]))
            end = min(len(data), end + PIECE)
        yield at, b"".join(parts)
        at = end - len(d.unused_data)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    more: dict = field(default_factory=dict)
    version: int = 1
    truncated: bool = False


def arc_header(version: int, name: str, date: str) -> bytes:
    lines = f"{version} 0 trailmill\n{' '.join(FIELDS[version])}\n".encode()
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(lines)}\n".encode() + lines + b"\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(lines)}\n".encode() + lines + b"\n"


def quoted(url: str) -> str:
    """A URL as ARC header lines hold it, without blanks."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "about:blank"


def arc_record(version: int, url: str, date: str, body: bytes, name: str, offset: int, content_type: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    url = quoted(url)
    if version == 1:
        head = f"{url} {ip} {date} {content_type} {len(body)}\n"
    else:
        head = f"{url} {ip} {date} {content_type} 200 {zlib.crc32(body):08x} - {offset} {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def read_arc(data: bytes):
    """Yield (member offset, ArcRecord) of an ARC archive, compressed or not; the first is its ``filedesc``."""
    names: list[str] = []
    version = 1
    for offset, part in gunzip(data):
        at = 0
        while at < len(part):
            if part[at] in b"\r\n":
                at += 1
                continue
            end = part.find(b"\n", at)
            if end < 0:
                raise ValueError("an ARC header line has no end")
            line = part[at:end].decode("utf-8", "replace").rstrip("\r")
            if not names:
                if not line.startswith("filedesc://"):
                    raise ValueError("an ARC archive begins with filedesc://")
                n = 10 if len(line.split(" ")) >= 10 else 5
                here = FIELDS[2 if n == 10 else 1]
            else:
                here = names
            parts = line.split(" ")
            if len(parts) < len(here) or not parts[-1].isdigit():
                raise ValueError(f"not an ARC header line: {line[:200]!r}")
            extra = len(parts) - len(here)  # an old URL can hold spaces
            f = dict(zip(here, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
            length = int(f.pop("Archive-length"))
            body = part[end + 1 : end + 1 + length]
            if not names:
                lines = body.decode("utf-8", "replace").split("\n")
                version = int(lines[0].split(" ")[0])
                names = lines[1].split() if len(lines) > 1 and lines[1].strip() else FIELDS[version]
                if names[-1] != "Archive-length" or names[0] != "URL":
                    raise ValueError(f"unknown ARC fields: {names}")
            url, ip, date, kind = f.pop("URL"), f.pop("IP-address", "0.0.0.0"), f.pop("Archive-date", ""), f.pop("Content-type", "")
            yield offset, ArcRecord(url, ip, date, kind, body, f, version, len(body) < length)
            at = end + 1 + length


def http_parts(body: bytes) -> tuple[bytes, bytes] | None:
    """(header with its blank line, payload) of an HTTP answer."""
    if not body.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def iso_date(date: str) -> str:
    d = (re.sub("[^0-9]", "", date) + "19700101000000"[len(re.sub("[^0-9]", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, row: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join((url, date, digest, row)))}>"


def row_of(header: bytes) -> str:
    m = re.search(rb"(?im)^" + ROW.encode() + rb":[ \t]*([^\r\n]*)", header)
    return m[1].decode() if m else ""


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def convert(r: ArcRecord, refers_to: tuple[int, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of the record of equal payload with ``refers_to`` (row, URL, date as
    in its ARC header) if given."""
    date = iso_date(r.date)
    if r.url.startswith("filedesc://"):
        info = f"software: trailmill\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {r.version}\r\n".encode()
        return warc_record("warcinfo", [("WARC-Record-ID", record_id(r.url, date, "")), ("WARC-Date", date), ("WARC-Filename", r.url[len("filedesc://") :]), ("Content-Type", "application/warc-fields")], info)
    parts = http_parts(r.body)
    header, payload = parts or (b"", r.body)
    digest, row = base32_sha1(payload), row_of(header)
    head = [("WARC-Record-ID", record_id(r.url, date, digest, row)), ("WARC-Date", date), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if r.truncated:
        head.append(("WARC-Truncated", "length"))
    if parts is None:
        return warc_record("resource", [*head, ("Content-Type", r.content_type or "application/octet-stream")], r.body)
    head.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        of, url, then = str(refers_to[0]), refers_to[1], iso_date(refers_to[2])
        link = [("WARC-Refers-To", record_id(url, then, digest, of)), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", then)]
        return warc_record("revisit", [*head, ("WARC-Profile", PROFILE), *link, (ROW_OF, of)], header)
    return warc_record("response", head, r.body)


def read_warc(data: bytes):
    """Yield (headers, block) of each record of a WARC archive."""
    for _, part in gunzip(data):
        at = 0
        while at < len(part):
            if part[at] in b"\r\n":
                at += 1
                continue
            end = part.index(b"\r\n\r\n", at)
            lines = part[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            n = int(h["Content-Length"])
            if end + 4 + n > len(part):
                raise ValueError("a WARC record is cut short")
            yield h, part[end + 4 : end + 4 + n]
            at = end + 4 + n


def write_arcs(pages: DataFrame, out: str, id_col: str, url_col: str, text_col: str, date: str = "20200101000000", bytes_per_archive: int = 8_000_000) -> DataFrame:
    """Write rows as ARC archives in ``out``; (arc, off, row, digest, url, date): one row per record. Versions alternate."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        members, size, index = [], 0, []

        def close():
            nonlocal members, size, index, n
            write_file(f"{out}/{part:06d}-{n:06d}.arc.gz", b"".join(members))
            table = pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["arc", "off", "row", "digest", "url", "date"])
            n, members, size, index = n + 1, [], 0, []
            return table

        raw = 0
        for b in batches:
            for i, u, t in zip(*b.columns):
                name = f"{part:06d}-{n:06d}.arc.gz"
                version = 1 + (part + n) % 2
                if not members:
                    members, raw = [gzip_member(arc_header(version, name, date))], 0
                    size = len(members[0])
                payload = (t.as_py() or "").encode("utf-8", "surrogatepass")
                row = "" if i.as_py() is None else str(i.as_py())
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ROW}: {row}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                m = gzip_member(arc_record(version, u.as_py() or "about:blank", date, body, name, size))
                index.append((f"{out}/{name}", size, i.as_py(), base32_sha1(payload), quoted(u.as_py() or "about:blank"), date))
                members.append(m)
                size += len(m)
                raw += len(body)
                if raw >= bytes_per_archive:
                    yield close()
        if index:
            yield close()

    src = pages.select(F.col(id_col).cast("bigint").alias("i"), F.col(url_col).alias("u"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "arc string, off bigint, row bigint, digest string, url string, date string")


def convert_archives(index: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Convert the archives of ``index`` (arc, off, row, digest, url, date); one row (warc, records) per archive.

    Of equal payloads the smallest row stays a response. An archive holds a bounded number of bytes, so the list of
    its records is bounded too."""
    # null where no record has a row: such records stay responses
    named = F.when(F.col("row").isNotNull(), F.struct("row", "url", "date"))
    first = index.groupBy("digest").agg(F.min(named).alias("first"))
    same = F.col("row").eqNullSafe(F.col("first.row"))
    decided = index.join(first, "digest").select("arc", "off", F.when(~same, F.col("first")).alias("of"))
    per = decided.groupBy("arc").agg(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("off", "of"))).alias("of"))

    def run(batches):
        for b in batches:
            paths, counts = [], []
            for arc, of in zip(*b.columns):
                name = arc.as_py()
                refers = {x["off"]: tuple(x["of"][c] for c in ("row", "url", "date")) for x in of.as_py()}
                members = []
                for off, r in read_arc(read_file(name)):
                    target = refers.get(off)
                    parts = http_parts(r.body)
                    small = parts is not None and len(parts[1]) < min_bytes
                    members.append(gzip_member(convert(r, None if target is None or small else target)))
                path = f"{out}/{name.rsplit('/', 1)[1].removesuffix('.arc.gz')}.warc.gz"
                write_file(path, b"".join(members))
                paths.append(path)
                counts.append(len(members))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["warc", "records"])

    # a number, or adaptive execution would put the small index' archives into one task
    n = max(1, min(10_000, index.select("arc").distinct().count()))
    return per.repartition(n, "arc").mapInArrow(run, "warc string, records bigint")


def read_archives(warcs: DataFrame, id_col: str) -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to): one row per response or revisit record."""

    def run(batches):
        for b in batches:
            for w in b.column(0):
                rows: list[list] = [[] for _ in range(5)]
                for h, block in read_warc(read_file(w.as_py())):
                    if h["WARC-Type"] not in ("response", "revisit"):
                        continue
                    header, payload = http_parts(block)
                    row = row_of(header)
                    given = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        n, digest, of = len(payload), base32_sha1(payload), None
                        if digest != given:
                            raise ValueError("a payload differs from its digest")
                    else:
                        n, digest, of = int(re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)", header)[1]), given, int(h[ROW_OF])
                    for c, v in zip(rows, (int(row) if row else None, n, digest, h["WARC-Type"], of)):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=[id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return warcs.mapInArrow(run, f"`{id_col}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    out = new_path(spark, "archives")
    index = materialize(write_arcs(pages, f"{out}/arc", id_col, url_col, text_col), "arc-index")
    warcs = materialize(convert_archives(index, f"{out}/warc", min_bytes), "warcs")
    return read_archives(warcs.repartition(max(1, min(10_000, warcs.count())), "warc"), id_col)


def op5_warc(spark, sf_dir):
    return pages_to_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) || '0' AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n,
      array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((strpos('0123456789abcdef', substr(h, CAST((i * 5) // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, CAST((i * 5) // 4 + 2 AS BIGINT), 1)) - 1) // CAST(pow(2, 3 - (i * 5) % 4) AS BIGINT)) % 32, 1)), '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
