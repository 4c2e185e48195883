"""Training-order materialisation: token sequences in fixed-stride binary shards, in a keyed random order.

Texts become the ids of a public byte-level BPE vocabulary (a rank file, a parameter), each text ends with the first free
id, EOS, and is cut into sequences of ``length`` tokens. There are two passes over the same input partitions: the first
encodes, counts sequences and keeps them in the shared folder, a file per batch of rows; the second deals them. All
sequences have a gapless index: counts per input partition, summed up, give each task its first index, so nothing is sorted
or shuffled for it. The kept files go as shards come: once all is dealt, each task that writes shards deletes its part of
them first. Where a file is missing (an executor was lost after that), its rows are encoded again. A keyed Feistel permutation with
cycle-walking maps the index to a global slot; it is a bijection of 0..n-1 for every n and key, so order is random
without a shuffle of keys. Slots are dealt by range: each task gets a range of shards and writes them one after the
other; slot s is record s % per_shard of shard s // per_shard, at a multiple of the stride. A reader resumes anywhere.

A shard is written under another name and renamed; a task that runs again writes the same bytes. The run is checked:
slots must be 0..n-1, each once, and a kept file must be of as many rows as are read again, else (the input changed between
the two passes) it is an error. Inputs must therefore be stable under recomputation: files, or a table that was written.

Defined cases: a null text is an empty one and has one sequence, EOS; a null id is flagged in the record; equal rows
each have sequences; an empty table gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path
from .storage import delete_file, read_file, write_file

PAD = 0xFFFF
#: A record: id, part (top bit: null id), number of tokens; then tokens of two bytes each.
HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
#: Sequences between the passes, tokens deflated.
PIECES = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("tokens", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Permutation:
    """Bijection of 0..n-1: a balanced Feistel network on the next even number of bits, walked until inside."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (_mix(right ^ k) & self.mask)
        return left << h | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (_mix(left ^ k) & self.mask), left
        return left << h | right

    def _walk(self, step, x) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slots(self, index) -> np.ndarray:
        return self._walk(self._once, index)

    def index(self, slots) -> np.ndarray:
        return self._walk(self._back, slots)


_ENCODERS: dict[str, tuple] = {}
#: A pattern, and what tiktoken itself puts for it as it runs faster. The pieces are the same: nothing follows the runs that
#: are now possessive, white space at the end goes whole in both, and where ``\s+(?!\S)`` fails there is one such character.
FASTER = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder(ranks: bytes) -> tuple:
    """(function from text to ids, EOS) of a rank file, made once per worker. EOS is the first free id."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines())}
        eos = max(table.values()) + 1
        if eos >= PAD:
            raise ValueError("ids of the vocabulary need more than two bytes")
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=FASTER.get(public_tokenizers.PATTERN, public_tokenizers.PATTERN), mergeable_ranks=table, special_tokens={}).encode_ordinary, eos
    return _ENCODERS[key]


def shard_path(out: str, shard: int) -> str:
    return f"{out}/shard-{shard:07d}.bin"


def kept_path(kept: str, partition: int, batch: int) -> str:
    return f"{kept}/{partition:07d}-{batch:06d}.arrows"


def write_shards(docs: DataFrame, out: str, key: int = 0, length: int = 512, id_col: str = "doc_id", text_col: str = "text", shard_records: int | None = None, ranks_path: str | None = None, tasks: int = 10_000) -> tuple[DataFrame, int, int]:
    """Write the shards to ``out``; (manifest, number of sequences, records per shard). The manifest has a row
    (shard, path, first_slot, records, sha256) per shard; at most ``tasks`` tasks write a range of shards each."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, whatever the data

    kept = new_path(docs.sparkSession, "sequences")

    def pieces(b):
        """Sequences of a batch of rows, some 10,000 at a time."""
        encode, eos = encoder(ranks.value)
        ids, parts, tokens = [], [], []

        def flush():
            nonlocal ids, parts, tokens
            got = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(tokens, pa.binary())], schema=PIECES)
            ids, parts, tokens = [], [], []
            return got

        for i, t in zip(*b.columns):
            found = [*encode(t.as_py()), eos]
            raw = struct.pack(f"<{len(found)}H", *found)
            for k, lo in enumerate(range(0, len(raw), 2 * length)):
                ids.append(i.as_py())
                parts.append(k)
                tokens.append(zlib.compress(raw[lo : lo + 2 * length], 1, -15))  # only until it is in its shard
            if len(ids) > 10_000:
                yield flush()
        if ids:
            yield flush()

    def count(batches):
        p, n, files = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PIECES.with_metadata({"rows": str(b.num_rows)})) as f:
                for x in pieces(b):
                    n += x.num_rows
                    f.write_batch(x)
            write_file(kept_path(kept, p, files), sink.getvalue())
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n], pa.int64()), pa.array([files], pa.int32())], names=["p", "n", "files"])

    first, total = {}, 0
    counted = sorted((r.p, r.n, r.files) for r in src.mapInArrow(count, "p int, n bigint, files int").collect())
    for p, n, _ in counted:
        first[p] = total
        total += n
    begins = docs.sparkSession.sparkContext.broadcast((first, [(p, files) for p, _, files in counted]))
    stride = HEAD_SIZE + 2 * length
    per_shard = shard_records or max(1024, min((64 << 20) // stride, total // 256))
    shards = max(1, -(-total // per_shard))
    per_task = -(-shards // min(shards, tasks))
    writers = -(-shards // per_task)

    def deal(batches):
        p, order = TaskContext.get().partitionId(), Permutation(total, key)
        at = begins.value[0].get(p, 0)
        for k, b in enumerate(batches):
            try:
                f = pa.ipc.open_stream(read_file(kept_path(kept, p, k)))
            except FileNotFoundError:
                f = pieces(b)
            else:
                if (rows := int(f.schema.metadata[b"rows"])) != b.num_rows:
                    raise ValueError(f"{b.num_rows} rows where {rows} were: the input changed between the passes")
            for x in f:
                slots = order.slots(np.arange(at, at + x.num_rows))
                at += x.num_rows
                shard = slots // per_shard
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(shard.astype(np.int32)), pa.array((shard // per_task).astype(np.int32)), *x.columns], names=["slot", "shard", "task", "id", "part", "tokens"])

    def write(batches):
        shard, body, start = None, [], 0
        for p, files in begins.value[1]:
            for k in range(files if p % writers == TaskContext.get().partitionId() else 0):
                delete_file(kept_path(kept, p, k))

        def close():
            data = b"".join(body)
            write_file(shard_path(out, shard), data)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([shard_path(out, shard)]), pa.array([start], pa.int64()), pa.array([len(data) // stride], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()])], names=["shard", "path", "first_slot", "records", "sha256"])

        for b in batches:
            for slot, s, i, part, tokens in zip(*(b.column(c).to_pylist() for c in ("slot", "shard", "id", "part", "tokens"))):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, body, start = s, [], s * per_shard
                if slot != start + len(body):
                    raise ValueError(f"slot {slot} where {start + len(body)} is due: the input changed between the passes")
                tokens = zlib.decompress(tokens, -15)
                body.append(struct.pack(HEAD, i or 0, part | (1 << 31) * (i is None), len(tokens) // 2) + tokens.ljust(2 * length, b"\xff"))
        if shard is not None:
            yield close()

    rows = src.mapInArrow(deal, "slot bigint, shard int, task int, id bigint, part int, tokens binary")
    dealt = rows.repartitionById(writers, F.col("task")).sortWithinPartitions("slot")
    manifest = materialize(dealt.mapInArrow(write, "shard int, path string, first_slot bigint, records bigint, sha256 string"), "manifest")
    if (n := manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]) != total:
        raise ValueError(f"{n} sequences written, {total} counted: the input changed between the passes")
    return manifest, total, per_shard


def read_records(path: str, length: int, start: int = 0, stop: int | None = None):
    """Yield (record number, id, part, tokens as little-endian pairs of bytes) of a shard from record ``start`` on."""
    stride = HEAD_SIZE + 2 * length
    data = read_file(path, start * stride, None if stop is None else (stop - start) * stride)
    for k in range(len(data) // stride):
        i, part, n = struct.unpack_from(HEAD, data, k * stride)
        at = k * stride + HEAD_SIZE
        yield start + k, None if part >> 31 else i, part & 0x7FFFFFFF, data[at : at + 2 * n]


def training_order(docs: DataFrame, key: int = 0, length: int = 512, id_col: str = "doc_id", text_col: str = "text", shard_records: int | None = None, ranks_path: str | None = None) -> DataFrame:
    """Write the shards to the shared folder, read them back: (slot, shard, byte_offset, id_col, part, n_tokens,
    tokens_crc32), one row per sequence."""
    out = new_path(docs.sparkSession, "shards")
    manifest, total, per_shard = write_shards(docs, out, key, length, id_col, text_col, shard_records, ranks_path)
    stride = HEAD_SIZE + 2 * length

    def read(batches):
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(shard * per_shard + k, shard, k * stride, i, part, len(t) // 2, zlib.crc32(t)) for k, i, part, t in read_records(path, length)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slot", "shard", "byte_offset", id_col, "part", "n_tokens", "tokens_crc32"])

        # a number, or adaptive execution would put a small manifest's shards into one task
    spread = manifest.select("shard", "path").repartition(min(10_000, max(1, -(-total // per_shard))), "shard")
    return spread.mapInArrow(read, f"slot bigint, shard int, byte_offset bigint, `{id_col}` bigint, part int, n_tokens int, tokens_crc32 bigint")


def op4_training_order(spark, sf_dir):
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
