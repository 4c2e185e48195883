"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For each prefix of a chunk the table stores the one token that its encoding ends with. The candidates are the pieces
that an Aho-Corasick automaton finds ending there; a candidate is right if it is compatible with the last token of the
prefix before it, that is, if the pair of them encodes to itself. Compatibility is tested by merging the pair's text
alone, and remembered. The ids are then recovered backwards from the whole chunk. A token sequence is the merge
result exactly if all its neighbours are compatible, so the table gives what merging the whole text would.

Chunks: no piece has a space mark after another character, so texts are cut before each run of space marks, and at
characters that no piece holds; results of chunks of at most ``KEPT`` characters are cached, up to a number of bytes.

Defined cases: null is an empty text and has no ids; characters outside the model become byte pieces (the unknown id
in a model without them); a very long chunk takes time linear in its length; equal rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
import sys

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Longer chunks are encoded each time.
KEPT = 256
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        c = b[i]
        i += 1
        r |= (c & 127) << s
        s += 7
        if c < 128:
            return r, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id. Only models of the kind that this module encodes are accepted: BPE, identity
    normalisation, a dummy prefix, white space kept."""
    import struct

    pieces, trainer, norm = [], {}, {}
    for f, v in _fields(data):
        if f == 1:
            x = dict(_fields(v))
            pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
        elif f == 2:
            trainer = dict(_fields(v))
        elif f == 3:
            norm = dict(_fields(v))
    if trainer.get(3) != 2 or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
        raise ValueError("not a BPE model with identity normalisation, dummy prefix and kept white space")
    if any(t not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for _, _, t in pieces):
        raise ValueError("the model has user-defined or unused pieces")
    return pieces


class PieceCodec:
    def __init__(self, data: bytes, cache_bytes: int = 64 << 20, pairs: int = 400_000):
        pieces = read_model(data)
        self.score = {p: s for p, s, t in pieces if t == _NORMAL}
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        self.unk = next((i for i, x in enumerate(pieces) if x[2] == _UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.out: list[bytes] = [p.replace(SPACE, " ").encode() if t == _NORMAL else bytes([int(p[3:5], 16)]) if t == _BYTE else b" \xe2\x81\x87 " if t == _UNKNOWN else b"" for p, _, t in pieces]
        self.is_byte = [t == _BYTE for _, _, t in pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space mark after another character")
        self.max_bytes, self.max_pairs = cache_bytes, pairs
        chars = sorted(set("".join(self.score)) | {SPACE})
        self.hard = re.compile("([^" + re.escape("".join(chars)) + "])")
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.text = {i: p for p, i in self.ids.items()}
        # characters that occur in pieces without a piece of their own take part in merges as well
        self.lone = {}
        for c in chars:
            if c not in self.ids:
                self.lone[c] = len(pieces) + len(self.lone)
                self.text[self.lone[c]] = c
        auto = ahocorasick.Automaton()
        for p, i in [*self.ids.items(), *self.lone.items()]:
            if self._merge(p) == [p]:
                auto.add_word(p, (len(p), i))
        auto.make_automaton()
        self.iter = auto.iter
        self.pair: dict[int, bool] = {}
        self.chunks: dict[str, str] = _Chunks(self)
        self.inner: dict[str, str] = {}
        self.inner_bytes = 0
        self.odd = False

    def _merge(self, s: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost among equals."""
        sym, score = list(s), self.score
        while len(sym) > 1:
            best, at = None, -1
            for i in range(len(sym) - 1):
                v = score.get(sym[i] + sym[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
        return sym

    def _table(self, s: str) -> list[int]:
        """Tokens of a chunk without foreign characters."""
        n = len(s)
        last, back, pair = [-1] * (n + 1), [0] * (n + 1), self.pair
        get = pair.get
        for end, (length, t) in self.iter(s):
            j = end - length
            if last[end] >= 0:
                continue
            if j >= 0:
                u = last[j]
                ok = get(u << 32 | t)
                if ok is None:
                    a, b = self.text[u], self.text[t]
                    ok = self._merge(a + b) == [a, b]
                    if len(pair) >= self.max_pairs:
                        pair.clear()
                    pair[u << 32 | t] = ok
                if not ok:
                    continue
            last[end], back[end] = t, j
        out, n = [], n - 1
        while n >= 0:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return out

    def _bytes(self, c: str) -> list[int]:
        return [self.byte.get(x, self.unk) for x in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]

    def chunk_ids(self, s: str) -> list[int]:
        if not self.lone and self.hard.search(s) is None:
            return self._table(s)
        out: list[int] = []
        for k, part in enumerate(self.hard.split(s)):
            if k % 2:
                out += self._bytes(part)
            elif part:
                for t in self._table(part):
                    out += [t] if t < len(self.out) else self._bytes(self.text[t])
        return out

    def _ready(self, key: str) -> str:
        """ids (decimal, with commas) of the chunk: a space mark and ``key``. It is cut further where two neighbouring
        characters occur in no piece. Its ids are decoded here as well; ``odd`` is set if that doesn't give it back."""
        s = SPACE + key.replace(" ", SPACE)
        inside, inner = self.inside, self.inner
        found, a = [], 0
        cuts = [i for i, pair in enumerate(map(str.__add__, s, s[1:]), 1) if pair not in inside]
        cuts.append(len(s))
        for b in cuts:
            part = s[a:b]
            a = b
            got = inner.get(part)
            if got is None:
                ids = self.chunk_ids(part)
                got = ",".join(map(str, ids))
                if self.decode_bytes(ids) != part.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                    self.odd = True
                elif len(part) <= KEPT:
                    self.inner_bytes += _held(part, got)
                    if self.inner_bytes > self.max_bytes:
                        inner.clear()
                        self.inner_bytes = _held(part, got)
                    inner[part] = got
            found.append(got)
        return ",".join(found)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.out.__getitem__, ids))

    @staticmethod
    def keys(text: str) -> list[str]:
        """The chunks of a non-empty text, each without its first space mark."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        keys = text.split(" ")
        if "" in keys:
            keys = [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        return keys

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """(ids as decimals with commas, decoded text). Chunks that decode to themselves, all of them in a model with
        byte pieces, decode to the text; else the ids are decoded one by one."""
        if not text:
            return "", ""
        self.odd = False
        ids = ",".join(map(self.chunks.__getitem__, self.keys(text)))
        if self.odd:
            return ids, self.decode([int(x) for x in ids.split(",")])
        return ids, text.replace(SPACE, " ")

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_text(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """As the library: each run of byte pieces is read as UTF-8, one replacement character for each byte that
        isn't; the dummy prefix is dropped."""
        out, run, first = [], [], True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run.append(self.out[i][0])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run, first = [], False
            if i is not None:
                s = self.out[i].decode()
                if first and s.startswith(" ") and i != self.unk:
                    s = s[1:]
                if self.out[i]:
                    first = False
                out.append(s)
        return "".join(out)


def _utf8(b: bytes) -> str:
    out, i = [], 0
    while i < len(b):
        n = 1 if b[i] < 0x80 else 2 if b[i] >> 5 == 6 else 3 if b[i] >> 4 == 14 else 4 if b[i] >> 3 == 30 else 1
        try:
            out.append(b[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def _held(key: str, value: str) -> int:
    """Bytes that an entry of a cache takes, its place in the table included."""
    return sys.getsizeof(key) + sys.getsizeof(value) + 100


class _Chunks(dict):
    """Cache of two generations: what is asked for again stays when the older half goes."""

    def __init__(self, codec: PieceCodec):
        self.codec, self.old, self.bytes = codec, {}, 0

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            odd, self.codec.odd = self.codec.odd, False
            got = self.codec._ready(key)
            if self.codec.odd:  # not kept, so that it is noticed again
                return got
            self.codec.odd = odd
            if "\n" in key or len(key) > KEPT:
                return got
        self.bytes += _held(key, got)
        if self.bytes > self.codec.max_bytes:
            self.old = dict(self)
            self.clear()
            self.bytes = _held(key, got)
        self[key] = got
        return got


_CODECS: dict[str, PieceCodec] = {}


def codec_of(data: bytes) -> PieceCodec:
    """One codec per worker and model."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(data)
    return _CODECS[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded string]) per row of ``docs``."""
    with open(model_path or default_model(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # half a MB, whatever the data

    def run(batches):
        codec = codec_of(model.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, a, d, lists, texts = [], [], [], [], []
            for t in b.column(1):
                s, back = codec.encode_text(t.as_py())
                n.append(s.count(",") + 1 if s else 0)
                a.append(sha(s))
                d.append(sha(back))
                if ids:
                    lists.append([int(x) for x in s.split(",")] if s else [])
                    texts.append(back)
            more = [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())] if ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *more], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.dtypes[0][1]
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else ""))


def op8_sentencepiece(spark, sf_dir):
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
