"""Best-fit packing of tokenised documents by minimum bin slack.

Documents are tokenised where they are, longer ones are cut into full pieces and a rest. Only the number of
pieces of each length matters for what goes together, and that is a table of at most ``ROOM`` counts, however
many documents there are. From it sequences are filled one after the other: the longest piece left is set, and
bitset subset sums over the lengths that are left, as often as they are left, find the fullest combination that
goes with it; it is taken out, at once as often as the counts allow. Every piece then finds its place by its
number among the pieces of its length, which are counted in shares so that no length is numbered in one task.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm.common import settle, small, with_row_id

#: Tokens of a sequence; the id after each document.
ROOM, END = 4096, 1
ENDING = np.array([END], np.dtype("<u4"))
#: Words, and parts of words, whose ids a worker remembers, the first it meets; longer ones are tokenised anew each time.
WORDS, WORD = 400_000, 64
#: Words that are tokenised together.
TOGETHER = 1000
#: Fixed value: the tokenizer's parts of a word, here for lower-case letters below U+0180, where digits are these.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ſ0-9²³¹¼½¾]+")
#: Pieces of one length that are numbered together.
SHARE = 100_000


class Words:
    """Ids of whole texts, word by word.

    This tokenizer drops white space, and none of its steps (composing, lower case, splitting, added tokens, merges)
    looks across a space; so a text's ids are those of its words, and only words not met before are tokenised. Where
    all letters are simple a word falls into parts that are met more often still. Parts are tokenised together: what
    ends a part ends with a mark of its own in the vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs in parallel
        self.made = Tokenizer.from_file(path)
        self.made.no_truncation()
        self.made.no_padding()
        vocabulary = self.made.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.dtype("<u4")) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenise(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(parts), TOGETHER):
            own = parts[at : at + TOGETHER]
            ids = self._plain([" ".join(own)])[0]
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) != len(own) + 1 or cuts[-1] != len(ids):
                raise ValueError("the vocabulary does not mark the ends of words")
            yield from ((w, ids[i:j].tobytes()) for w, i, j in zip(own, cuts, cuts[1:], strict=False))

    def _learn(self, new: list[str]) -> list[str]:
        """Add what is new; returns the parts that were."""
        simple = {w: PARTS.findall(w.lower()) for w in new if (not w or w.isascii() or max(w) < "\u0180" and "\u0130" not in w) and "<|" not in w}
        parts = list({p for own in simple.values() for p in own}.difference(self.parts))
        self.parts.update(self._tokenise(parts))
        self.words.update((w, b"".join(map(self.parts.__getitem__, own))) for w, own in simple.items())
        others = [w for w in new if w not in simple]
        self.words.update(zip(others, (i.tobytes() for i in self._plain(others)), strict=True))
        return parts

    def _forget(self, known: dict[str, bytes], new: list[str]) -> None:
        """Leave out what of the new is too long or too much."""
        for w in new:
            if len(w) > WORD or len(known) > WORDS:
                del known[w]

    def ids(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text, followed by the end.

        Words are told apart and counted by Arrow, so that Python sees each once a batch, however often it comes.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        code = split.flatten().dictionary_encode()
        own = pc.binary_join(pa.ListArray.from_arrays([0, len(code.dictionary)], code.dictionary), " ")[0].as_py().split(" ")  # faster than to_pylist
        new = [w for w in own if w not in self.words]
        parts = self._learn(new)
        made = pa.array(map(self.words.__getitem__, own), pa.large_binary())
        self._forget(self.words, new)
        self._forget(self.parts, parts)
        flat = made.take(code.indices)
        _, starts, data = flat.buffers()
        tokens = np.frombuffer(data or b"", np.dtype("<u4"))
        cuts = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist()
        return [np.concatenate([tokens[i // 4 : j // 4], ENDING]) for i, j in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """``_row``, doc_id, piece, start, length and ids_crc32 of each piece, in the order of its document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _words(path)
        for b in small(batches, 1024, 4 << 20):
            rows, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            out = []
            for row, doc, tokens in zip(rows.tolist(), ids, made.ids(pc.fill_null(b.column(2), "")), strict=True):
                for n, at in enumerate(range(0, len(tokens), room)):
                    part = tokens[at : at + room]
                    out.append((row, doc, n, at, len(part), zlib.crc32(part.tobytes())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["_row", "doc_id", "piece", "start", "length", "ids_crc32"])

    base = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_row").select("_row", "doc_id", "text")
    return base.mapInArrow(cut, "_row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with their numbers whose sum is the largest within ``room``, by bitset subset sums.

    Bit s of a set says that some of the lengths so far sum to s. Lengths are added from the longest on, each
    as 1, 2, 4 ... copies, until ``room`` itself is reached or none is left; the sets that grew lead back from
    the largest sum to what it is made of. ``lengths`` ascend.
    """
    within = (1 << (room + 1)) - 1
    reach, grown = 1, []
    for k in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left = min(counts[length], room // length)
        copies = 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            before = reach
            reach |= reach << copies * length & within
            if reach != before:
                grown.append((before, length, copies))
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, copies in reversed(grown):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= copies * length
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings from the counts by length: how many sequences are filled so, and lengths with their numbers in each."""
    counts = {k: n for k, n in counts.items() if n}
    lengths = sorted(counts)
    out = []
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        rest = dict(fullest(lengths, counts, room - longest))
        counts[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in rest.items())
        out.append((times, sorted(rest.items(), reverse=True)))
        for k, n in rest.items():
            counts[k] -= times * n
            if not counts[k]:
                lengths.pop(bisect.bisect_left(lengths, k))
    return out


class Places:
    """Where the pieces of each length go, by their number."""

    def __init__(self, fillings: list[tuple[int, list[tuple[int, int]]]]):
        made: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for times, filling in fillings:
            offset = 0
            for length, n in filling:
                made.setdefault(length, []).append((used.get(length, 0), base, n, offset))
                used[length] = used.get(length, 0) + times * n
                offset += n * length
            base += times
        self.of = {k: np.array(v, np.int64) for k, v in made.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length).tolist():
            at = np.flatnonzero(length == k)
            own = self.of[k]
            first, base, n, start = own[np.searchsorted(own[:, 0], number[at], "right") - 1].T
            turn = number[at] - first
            sequence[at], offset[at] = base + turn // n, start + turn % n * k
        return sequence, offset


def numbered(made: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """Pieces with their ``number`` from 0 among those of their length; ``counts`` has one row a length.

    A length's pieces are dealt into shares by hash and numbered within; what precedes a share follows from one row a share.
    """
    shares = counts.select("length", F.ceil(F.col("n") / share).alias("_shares"))
    dealt = made.join(F.broadcast(shares), "length").withColumn("_share", F.pmod(F.xxhash64("_row", "piece"), F.col("_shares"))).drop("_shares")
    sizes = dealt.groupBy("length", "_share").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_share", F.coalesce(before, F.lit(0).cast("long")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_share").orderBy("_row", "piece")) - 1
    return dealt.withColumn("_own", own).join(bases, ["length", "_share"]).withColumn("number", F.col("_own") + F.col("_base")).drop("_own", "_base", "_share")


def pack(docs: DataFrame, path: str, room: int = ROOM, share: int = SHARE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document row.

    A null text counts as empty: its only token is the end. Repeated rows, and rows without a doc_id, are documents
    of their own. An empty table gives no row. Sequences are numbered from 0 without gaps.
    """
    made = settle(pieces(docs, path, room))
    counts = settle(made.groupBy("length").agg(F.count(F.lit(1)).alias("n")), 1)
    places = Places(plan({r["length"]: r["n"] for r in counts.collect()}, room))  # at most ``room`` rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = places.find(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, found)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = numbered(made, counts, share).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
