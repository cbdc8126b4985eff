"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to three bytes long is counted from a bounded sample of labelled
documents. A byte's probability under a context follows method C: what the context has seen shares its counts,
and an escape, as likely as it has distinct successors, leads to the next shorter context, where what was
already ruled out is left aside; below all contexts the 256 bytes are alike. The statistics are then frozen, and the
trees are kept whole as sorted keys of what was seen: the code length of each byte seen after a context, and the cost
of each context's escape. A text's exact code length in each language is a sum of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import join_small, settle, small

#: Documents of each language in the sample, as expected of the hash threshold that draws them.
SAMPLE = 1000
#: Languages whose trees share one table; more are scored group by group, so that tables grow in proportion.
TOGETHER = 8
#: A sure prediction needs no more evidence than that of so many bytes; see ``score``.
EVIDENCE = 24
#: Bits a byte from which a text is no language that was learned: its model saves nothing over plain bytes.
FOREIGN = 8.0
#: Bytes looked up at a time.
CHUNK = 1 << 18
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts in a row, each byte's place in its text, and the lengths."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    return data, np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths), lengths


def _before(data: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(data)
    out[n:] = data[:-n]
    out[place < n] = 0
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of three bytes of context and the byte after them, packed; byte 0 stands before a text."""
    for b in small(batches):
        langs = np.array(b.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            data, place, _ = _grams(b.column(1).filter(pa.array(langs == lang)))
            if len(data):
                key = data.astype(np.int64)
                for n in (1, 2, 3):
                    key |= _before(data, place, n).astype(np.int64) << 8 * n
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])


def sample_counts(docs: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Counts by language of the sampled documents' byte contexts: about ``sample`` documents of each language.

    They come to the driver and go back as the broadcast model, so both are in proportion to the number of languages
    (about a megabyte each at 1,000 documents of 2,000 bytes) and independent of the number of documents.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = settle(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), 1)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40) < sample / F.col("_n")
    rows = join_small(labelled.select("doc_id", "lang", "text"), counts, "lang", "inner", counts.count()).where(drawn).select(F.col("lang").cast("string"), "text")
    grams = rows.mapInArrow(_count, "lang string, key long, n long")
    return grams.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()


def _escapes(total: np.ndarray, kinds: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Method C with exclusion: each context's escape, and its factor for what the shorter context gives the unseen."""
    escape = np.where(kinds < 256, kinds / np.maximum(total + kinds, 1), 0.0)
    return escape, escape / np.maximum(1 - covered, 1e-300)


def _dense(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of all bytes (last axis) from counts over those of the shorter context."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    escape, factor = _escapes(total, kinds, np.where(counts > 0, lower, 0).sum(-1, keepdims=True))
    return np.where(total > 0, np.where(counts > 0, counts / np.maximum(total, 1) * (1 - escape), factor * lower), lower)


class Level:
    """What one language has seen after contexts of one length: sorted keys (context, byte) and contexts, with bits."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, lower):
        self.keys, self.lower = keys, lower
        self.contexts, first, of = np.unique(keys >> 8, return_index=True, return_inverse=True)
        if not len(keys):
            self.bits = self.escape = np.empty(0)
            return
        total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
        escape, factor = _escapes(total, kinds, np.add.reduceat(np.exp2(-lower(keys)), first))
        self.bits = -np.log2(n / total[of] * (1 - escape[of]))
        with np.errstate(divide="ignore"):
            self.escape = -np.log2(factor)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each key: as seen, or by escape, or of the shorter context where this one never occurred."""
        at = np.searchsorted(self.keys, keys)
        seen = np.isin(keys, self.keys)
        out = np.empty(len(keys))
        out[seen] = self.bits[at[seen]]
        rest = keys[~seen]
        at = np.minimum(np.searchsorted(self.contexts, rest >> 8), max(0, len(self.contexts) - 1))
        known = self.contexts[at] == rest >> 8 if len(self.contexts) else np.zeros(len(rest), bool)
        out[~seen] = self.lower(rest) + (np.where(known, self.escape[at], 0) if len(self.contexts) else 0)
        return out


class Finder:
    """Places of keys in an array of distinct ones: open addressing, tried for all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.log = keys, max(8, int(8 * len(keys) + 8).bit_length())
        self.slots = np.full(1 << self.log, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slots[at[put]] = left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.log) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        at = self._first(keys)
        out = self.slots[at]
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.empty(0, int)
        at = at[other]
        while len(other):
            at = (at + 1) & ((1 << self.log) - 1)
            out[other] = now = self.slots[at]
            more = (now >= 0) & (self.keys[now] != keys[other])
            other, at = other[more], at[more]
        return out


class Trees:
    """The trees of some languages side by side: rows for every key that any of them has seen."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        one, two, three = [], [], []
        for key, n in parts:
            def sums(mask: int, key=key, n=n) -> tuple[np.ndarray, np.ndarray]:
                keys, of = np.unique(key & mask, return_inverse=True)
                return keys, np.bincount(of, weights=n, minlength=len(keys))

            counts = np.bincount(key & 0xFFFF, weights=n, minlength=1 << 16).reshape(256, 256)
            p = _dense(counts, _dense(counts.sum(0), np.full(256, 1 / 256))[None])
            first = -np.log2(p.reshape(-1))
            second = Level(*sums(0xFFFFFF), lambda k, first=first: first[k & 0xFFFF])
            one.append(first), two.append(second)
            three.append(Level(*sums(0xFFFFFFFF), lambda k, second=second: second(k & 0xFFFFFF)))
        self.one = np.stack(one, axis=1).astype(np.float32)
        self.tables = []
        for levels in (three, two):
            keys, contexts = (np.unique(np.concatenate(x)) for x in ([v.keys for v in levels], [v.contexts for v in levels]))
            bits = np.stack([v(keys) for v in levels], axis=1).astype(np.float32)
            escapes = np.zeros((len(contexts), len(levels)), np.float32)
            for i, v in enumerate(levels):
                escapes[np.searchsorted(contexts, v.contexts), i] = v.escape
            self.tables.append((Finder(keys), bits, Finder(contexts), escapes))

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Bits of each key (three bytes of context and the byte after them) in each language."""
        out, rows, base = np.empty((len(key), self.one.shape[1]), np.float32), slice(None), 0.0
        for (keys, bits, contexts, escapes), mask in zip(self.tables, (0xFFFFFFFF, 0xFFFFFF), strict=True):
            key = key & mask
            at = keys.find(key)
            out[rows] = base + bits[at]  # what was not found is written again below
            lost = np.flatnonzero(at < 0)
            if not len(lost):
                return out
            key = key[lost]
            of = contexts.find(key >> 8)
            base = (base[lost] if isinstance(base, np.ndarray) else base) + np.where((of >= 0)[:, None], escapes[of], 0)
            rows = lost if isinstance(rows, slice) else rows[lost]
        out[rows] = base + self.one[key & 0xFFFF]
        return out


class Model:
    """Code lengths in bits in each learned language; memory is in proportion to the counts of the samples."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique().tolist()) if len(counts) else []
        own = [counts[counts["lang"] == x] for x in self.langs]
        parts = [(c["key"].to_numpy(np.int64), c["n"].to_numpy(float)) for c in own]
        self.trees = [Trees(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]

    def lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and bytes of each text."""
        data, place, sizes = _grams(texts)
        out, text = np.zeros((len(sizes), len(self.langs))), np.repeat(np.arange(len(sizes)), sizes)
        for lo in range(0, len(data), CHUNK):
            skip = min(lo, 3)
            d, p = data[lo - skip : lo + CHUNK], place[lo - skip : lo + CHUNK]
            key = d.astype(np.int64)
            for n in (1, 2, 3):
                key |= _before(d, p, n).astype(np.int64) << 8 * n
            key, of = key[skip:], text[lo : lo + CHUNK]
            for g, trees in enumerate(self.trees):
                bits = trees.bits(key)
                for i in range(bits.shape[1]):
                    out[of[0] : of[-1] + 1, g * TOGETHER + i] += np.bincount(of - of[0], weights=bits[:, i])
        return out, sizes

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of each text.

        The score is the language's share of probability among those learned, with the evidence of a longer
        text brought down to that of ``EVIDENCE`` bytes, so that it tells mixed texts from plain ones.
        """
        letters = pc.fill_null(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits, size = self.lengths(texts)
        best = bits.argmin(1)
        lowest = bits[np.arange(len(bits)), best]
        over = (bits - lowest[:, None]) * np.minimum(1, EVIDENCE / np.maximum(size, 1))[:, None]
        score = np.where(letters, 1 / np.exp2(-np.minimum(over, 1000)).sum(1), 0.0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)], score, lowest / np.maximum(size, 1)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of labelled documents that are not held out."""
    return Model(sample_counts(docs, sample))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all rows with ``__sw_lang``, ``__sw_score`` and ``__sw_bits`` (bits a byte), from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned.
    Repeated rows get equal results; an empty table gives none; a doc_id is not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lang, score, bits = shared.value.predict(b.column(b.schema.get_field_index("text")))
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], [*keep, "__sw_lang", "__sw_score", "__sw_bits"])

    rows = docs.withColumn("text", F.col("text").cast("string")).select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, __sw_lang string, __sw_score double, __sw_bits double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document row; see ``predict``."""
    found = predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("__sw_lang").alias("lang_pred"), F.col("__sw_score").alias("score"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in a language that was learned: not ``und``, nor coded as badly as a foreign one.

    Null, empty and letterless texts go, as do all if nothing could be learned; repeated rows stay or go together; an
    empty table stays empty. Columns stay as they are, whatever they are called.
    """
    found = predict(docs, train(docs), docs.columns)
    return found.where((F.col("__sw_lang") != UNKNOWN) & (F.col("__sw_bits") < FOREIGN)).select(*docs.columns)
