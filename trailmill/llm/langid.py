"""Language identification by cross-parsing entropy.

A sample of labelled text per language becomes a suffix automaton. A text is parsed, from left to right, into the
longest phrases that occur in the language's sample (a longest match, then one fresh start); few phrases mean that the
sample predicts the text well. The cost of a language is phrases * log2(sample length), normalised by the text's
length; the cheapest language wins, ties go to the smaller label.

The automata's transitions are one hash table of (state, symbol), whose size grows with the transitions only; a letter
that has none begins the next phrase. Where states times symbols are few (``dense_cells``), the table is spelled out, as
one look-up is faster; the result is the same. Texts are parsed in blocks of ``block`` characters, many blocks and all languages
at a time. Each block is first parsed on its own; then the phrase that is open at its begin is carried on until a phrase
begins where one began before, from where on both parses agree. So the blocks don't show in the result.

Sample bound: ``train_chars`` characters per language, from different texts among the ``train_docs`` labelled ones of
the least hash, each from a place in the text that its hash names.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0; no labelled rows at all give ``und``
for every row; an empty table gives an empty result; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

UNKNOWN = "und"
_FLAG = np.uint32(1 << 31)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, its lower-case letter's code point, or 0 if it is no letter."""
    if not _LETTERS:
        lut = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                lut[cp] = ord(low) if len(low) == 1 else cp
        _LETTERS.append(lut)
    return _LETTERS[0]


def _code_points(text: str) -> np.ndarray:
    """Lower-case letters as code points; each run of other characters is one 0."""
    cps = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(cps) > 1:
        keep = np.ones(len(cps), dtype=bool)
        keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0)
        cps = cps[keep]
    return cps


class SuffixAutomaton:
    """Accepts each substring of a sequence of symbols."""

    def __init__(self, symbols):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt


class Transitions:
    """(state, symbol) -> state, in an open hash table of at most a quarter load."""

    _EMPTY = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self._EMPTY, dtype=np.uint64)
        self.targets = np.zeros(1 << bits, dtype=np.uint32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            some = left[self.keys[at[left]] == self._EMPTY]
            slots, who = np.unique(at[some], return_index=True)  # one key takes a free slot
            self.keys[slots], self.targets[slots] = keys[some[who]], targets[some[who]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The states of ``keys``; those of ``other`` where there is none."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.targets[at], other)
        more = np.nonzero((seen != keys) & (seen != self._EMPTY))
        while len(more[0]):
            at[more] = (at[more] + 1) & self.mask
            seen = self.keys[at[more]]
            hit = seen == keys[more]
            found = tuple(m[hit] for m in more)
            out[found] = self.targets[at[found]]
            go = ~hit & (seen != self._EMPTY)
            more = tuple(m[go] for m in more)
        return out


class CrossParser:
    """Languages' automata in one table."""

    def __init__(self, samples: dict[str, str], dense_cells: int = 1 << 24):
        self.langs = sorted(samples)
        seqs = [_code_points(samples[x]) for x in self.langs]
        known = np.unique(np.concatenate([*seqs, np.zeros(1, np.uint32)]))  # 0, the gap, comes first
        self.symbols = len(known) + 1  # the last stands for all other letters
        self.lut = np.full(sys.maxunicode + 1, len(known), dtype=np.uint8 if self.symbols < 256 else np.uint32)
        self.lut[known] = np.arange(len(known))
        keys, targets, between, base = [], [], [], 0
        self.first = np.zeros((len(seqs), self.symbols), dtype=np.uint32)  # the state that a phrase's first letter leads to
        for k, seq in enumerate(seqs):
            auto = SuffixAutomaton(self.lut[seq].tolist())
            n = len(auto.next)
            keys.append(np.array([(base + i) * self.symbols + c for i, m in enumerate(auto.next) for c in m], dtype=np.uint64))
            targets.append(np.array([base + x for m in auto.next for x in m.values()], dtype=np.uint32))
            # one more state stands between phrases: the next letter begins one. A letter that never occurs leads back to it
            between.append(base + n)
            self.first[k] = base + n
            for c, x in auto.next[0].items():
                self.first[k, c] = base + x
            base += n + 1
        if base >= int(_FLAG):
            raise ValueError("the samples are too large for 31-bit states")
        self.first |= _FLAG
        self.moves = Transitions(np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*targets, np.zeros(0, np.uint32)]))
        self.roots = np.array(between, dtype=np.uint32)
        self.dense = None
        if base * self.symbols <= dense_cells:
            ends = [0, *(int(r) + 1 for r in self.roots)]
            spans = [np.arange(a * self.symbols, b * self.symbols, dtype=np.uint64) for a, b in zip(ends, ends[1:])]
            rows = [self.moves.get(x, np.tile(f, len(x) // self.symbols)) for x, f in zip(spans, self.first)]
            self.dense = np.concatenate([*rows, np.zeros(0, np.uint32)])
        self.bits = np.array([math.log2(max(2, len(s))) for s in seqs])

    def _step(self, state: np.ndarray, codes: np.ndarray, langs) -> np.ndarray:
        if self.dense is not None:
            return self.dense[state * np.uint32(self.symbols) + codes]
        return self.moves.get(state.astype(np.uint64) * np.uint64(self.symbols) + codes.astype(np.uint64), self.first[langs, codes])

    def phrases(self, texts: list[np.ndarray], block: int) -> np.ndarray:
        """Phrases per language (rows) and text (columns); texts as code points."""
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(texts) or not lens.sum():
            return out
        codes = self.lut[np.concatenate(texts)]
        nb = -(-lens // block)
        owner = np.repeat(np.arange(len(texts)), nb)
        within = np.arange(nb.sum()) - np.repeat(np.cumsum(nb) - nb, nb)
        start = np.repeat(np.cumsum(lens) - lens, nb) + within * block
        size = np.minimum(block, np.repeat(lens, nb) - within * block)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.where(within[order] > 0, place[order - 1], -1)  # the block that a block goes on from
        owner, start, size = owner[order], start[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1), "left")
        state = np.repeat(self.roots[:, None], len(size), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        begins = []
        for t in range(int(size[0])):
            a = active[t]
            c = codes[start[:a] + t]
            nxt = self._step(state[:, :a], c, slice(None))
            begins.append(nxt >= _FLAG)
            count[:, :a] += begins[-1]
            state[:, :a] = nxt & ~_FLAG
        # carry open phrases over the begins of blocks; again where a block's end changed by that, up to no change
        alone, extra = state.copy(), np.zeros_like(count)
        given = np.repeat(self.roots[:, None], len(size), axis=1)
        lanes = np.flatnonzero(before >= 0)
        while True:
            ends = state[:, before[lanes]]
            k, j = np.nonzero(ends != given[:, lanes])
            lane, now = lanes[j], ends[k, j]
            if not len(lane):
                break
            given[k, lane] = now
            by_size = np.argsort(lane, kind="stable")
            k, lane, now = k[by_size], lane[by_size], now[by_size]
            more, met = np.zeros(len(lane), np.int64), np.zeros(len(lane), bool)
            state[k, lane] = alone[k, lane]  # unless the carried parse gets to the end
            for t in range(int(size[lane[0]]) + 1):
                ended = size[lane] <= t if size[lane[-1]] <= t else None
                if ended is not None or t % 16 == 0:
                    if ended is not None:
                        state[k[ended], lane[ended]] = now[ended]
                    out_of = met if ended is None else met | ended
                    extra[k[out_of], lane[out_of]] = more[out_of]
                    go = ~out_of
                    k, lane, now, more, met = k[go], lane[go], now[go], more[go], met[go]
                    at = start[lane]
                    if not len(lane):
                        break
                nxt = self._step(now, codes[at + t], k)
                mine, own = nxt >= _FLAG, begins[t][k, lane]
                more += mine
                more -= own
                met |= mine & own
                now = nxt & ~_FLAG
        count += extra
        for k in range(len(self.langs)):
            out[k] = np.bincount(owner, weights=count[k], minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts, block: int = 512, group_chars: int = 2_000_000) -> tuple[list[str], list[float]]:
        """Languages and scores of texts (strings or nulls); about ``group_chars`` characters are held at a time."""
        langs, scores, group, seqs, held = [], [], [], [], 0

        def flush():
            bits = self.phrases(seqs, block) * self.bits[:, None]
            odds = np.exp2(-np.minimum(bits - bits.min(axis=0), 200.0))
            for j, b, p in zip(group, bits.argmin(axis=0), 1 / odds.sum(axis=0)):
                langs[j], scores[j] = self.langs[b], float(p)

        for i, t in enumerate(texts):
            langs.append(UNKNOWN)
            scores.append(0.0)
            s = _code_points(t or "")
            if not self.langs or not s.any():
                continue
            group.append(i)
            seqs.append(s)
            held += len(s)
            if held >= group_chars:
                flush()
                group, seqs, held = [], [], 0
        if group:
            flush()
        return langs, scores


def training_samples(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, train_chars: int) -> dict[str, str]:
    """Text per language: of the rows of least hash, different texts of at most ``train_docs`` rows and ``train_chars``
    characters, from a place in each text that its hash names."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("g"), F.xxhash64(text_col).alias("h"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    # ids can be null or repeated: different texts are told apart by their hash, and each stands for itself once
    keys = materialize(rows.groupBy("g", "h").agg(F.pmod(F.min(F.xxhash64("i", "h")), F.lit(1 << 30)).alias("k")), "language-texts")
    # a threshold leaves a few times the texts needed of each language, so the ranks are of few rows
    chance = F.lit(0.0)
    for lang, n in keys.groupBy("g").count().collect():
        chance = F.when(F.col("g") == lang, min(1.0, (3.0 * train_docs + 100) / n)).otherwise(chance)
    rank = F.row_number().over(Window.partitionBy("g").orderBy("k", "h"))
    few = keys.where(F.col("k") <= chance * float(1 << 30))
    least = few.withColumn("r", rank).where(F.col("r") <= train_docs).select(F.col("g").alias("g2"), F.col("h").alias("h2"), "k")
    each = max(1, train_chars // train_docs)
    room = F.greatest(F.lit(1), F.char_length("t") - 4 * each + 1)
    at = (F.pmod(F.col("h"), room) + 1).cast("int")
    # at most train_docs rows a language: broadcast, and their cuts are all that is collected
    some = rows.join(F.broadcast(least), (F.col("g") == F.col("g2")) & (F.col("h") == F.col("h2")))
    picked = some.groupBy("g", "h").agg(F.min("k").alias("k"), F.min(F.substring(F.col("t"), at, F.lit(4 * each))).alias("t")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r.g, r.k, r.t)):
        got = out.setdefault(r.g, [])
        if len(got) < train_docs:
            got.append(r.t)
    samples = {}
    for g, texts in out.items():
        share = max(each, train_chars // len(texts))
        samples[g] = "\n".join(t[:share] for t in texts)[:train_chars]
    return samples


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", out_lang: str = "lang_pred", out_score: str = "score", block: int = 512, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) and two more; columns of these two names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out_lang, out_score)]
    src = docs.select(F.col(text_col).alias("__text"), *keep)
    model = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        parser = _parser(model.value)
        for b in batches:
            langs, scores = parser.predict((x.as_py() for x in b.column(0)), block)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, out_lang, out_score])

    schema = src.select(*keep, F.lit("").alias(out_lang), F.lit(0.0).alias(out_score)).schema
    return src.mapInArrow(run, schema)


_MADE: dict[tuple, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, made once per worker."""
    key = tuple(sorted((k, hash(v)) for k, v in samples.items()))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = CrossParser(samples)
    return _MADE[key]


def is_held_out(id_col: str = "doc_id"):
    """True for the rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 64, train_chars: int = 32_000) -> dict[str, str]:
    """Samples of the rows that are not held out."""
    return training_samples(docs.where(~is_held_out(id_col)), id_col, text_col, lang_col, train_docs, train_chars)


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return identify(named, learn(docs), keep=["doc_id", "held_out"])
