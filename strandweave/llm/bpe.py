"""Byte-level BPE encoding of whole texts, long ones by tree concatenation.

Short texts are encoded where they are. A long text is cut into pieces without regard to words, which are
encoded in parallel; neighbours are then joined in a tree. At a join the end of the left side and the start
of the right one may be split wrongly. So a window around the cut is encoded anew, starting at the last
place left of the cut at which the splitting is known to be right, and grown until it falls in with the
right side. An unsplit run of characters too long for one encoding is itself encoded by halves: the window
then grows token by token until the tokens at both its edges are those that their texts give when joined.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import as_many_parts, small, with_row_id

#: Fixed value: the splitting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The one added token, which stands for itself in a text.
MARK, MARK_ID = "<|endoftext|>", 50256
#: Texts of more code points are cut into pieces of this many.
PIECE = 32_768
#: Bytes of an unsplit run above which it is encoded by halves.
RUN = 4_096
#: Characters from the start of a part that may settle how it is split (a contraction of three).
LOOK = 3
#: Pieces encoded at a time: while their tokens are Python lists, each takes about a megabyte.
PIECES = 16


def vocabulary(json_path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary file, without the added tokens."""
    import json

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    with open(json_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


class Codec:
    """Encodes and decodes with the vocabulary of one file."""

    def __init__(self, path: str):
        ranks = vocabulary(path)
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()} | {MARK_ID: MARK.encode()}
        self.split = regex.compile(PATTERN)

    def _run(self, run: bytes) -> list[int]:
        """Tokens of one unsplit run, by halves if it is long."""
        if len(run) <= RUN:
            return self.bpe._encode_single_piece(run)
        half = len(run) // 2
        return self._join_run(self._run(run[:half]), self._run(run[half:]))

    def _agree(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are just what their joined text gives."""
        return self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        n = 1
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            mid = self.bpe._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self._agree(left[i - 1], mid[0])) and (j == len(right) or self._agree(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            n *= 2

    def _plain(self, text: str) -> list[int]:
        """Tokens of a text without the added token."""
        if len(text) > RUN // 4 and max(map(len, text.split()), default=0) > RUN // 4:
            return [t for m in self.split.finditer(text) for t in self._run(m.group().encode())]
        return self.bpe.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """The ids of one whole text."""
        parts = text.split(MARK)
        out = self._plain(parts[0])
        for p in parts[1:]:
            out.append(MARK_ID)
            out += self._plain(p)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def starts(self, text: str) -> list[int]:
        """Where the parts of the splitting begin."""
        return [m.start() for m in self.split.finditer(text)]

    def join(self, left: tuple, right: tuple) -> tuple:
        """Join two encoded neighbours (text, places, ids), given by place: ids[n] belong to places[n].

        A part is split rightly if it ends before its text does and starts ``LOOK`` or more characters before
        that end, as the pattern looks one character past a part and three from its start on. From the left
        side's first other part on, the window is split anew, a growing number of the right side's parts with
        it, until one of the window's own cuts, as far from its end, is one of the right side's.
        """
        (a, cut_a, ids_a), (b, cut_b, ids_b) = left, right
        if not a or not b:
            return right if not a else left
        last = next(k for k, c in enumerate(cut_a) if c > len(a) - LOOK or k == len(cut_a) - 1)
        at, n = cut_a[last], 2
        tail = a[at:]
        while True:
            j = min(len(cut_b), n)
            stop = cut_b[j] if j < len(cut_b) else len(b)
            window = tail + b[:stop]
            cuts = self.starts(window)
            right_of = {c: k for k, c in enumerate(cut_b[:j])}
            whole = j == len(cut_b)
            meet = next((c for c in cuts if c >= len(tail) and (c - len(tail)) in right_of and c + LOOK - 1 <= len(window)), None)
            if meet is None and not whole:
                n *= 2
                continue
            own = [c for c in cuts if meet is None or c < meet]
            ends = own[1:] + [len(window) if meet is None else meet]
            ids = [self._run(window[c:e].encode()) for c, e in zip(own, ends, strict=True)]
            k = len(cut_b) if meet is None else right_of[meet - len(tail)]
            cuts = cut_a[:last] + [at + c for c in own] + [len(a) + c for c in cut_b[k:]]
            return a + b, cuts, ids_a[:last] + ids + ids_b[k:]

    def piece(self, text: str) -> tuple:
        cuts = self.starts(text)
        ends = cuts[1:] + [len(text)] if cuts else []
        return text, cuts, [self._run(text[c:e].encode()) for c, e in zip(cuts, ends, strict=True)]

    def tree(self, pieces: list[tuple]) -> tuple:
        """Join encoded neighbours pairwise until one is left."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else ("", [], [])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def digests(ids: list[int], decoded: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _encode_whole(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small(batches):
            made = []
            for text in b.column(1).to_pylist():
                ids = c.encode(text or "")
                made.append(digests(ids, c.decode(ids)))
            cols = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def _encode_pieces(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small(batches, PIECES):
            made = [c.piece(t) for t in b.column(4).to_pylist()]
            cuts = pa.array([np.array(m[1], np.int32).tobytes() for m in made], pa.binary())
            counts = pa.array([np.array(list(map(len, m[2])), np.int32).tobytes() for m in made], pa.binary())
            ids = pa.array([np.array([i for x in m[2] for i in x], np.int32).tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], cuts, counts, ids], ["_row", "doc_id", "seg", "seq", "piece", "cuts", "counts", "ids"])

    return encode


def _join_pieces(path: str):
    def unpack(row) -> tuple:
        ids, ends = np.frombuffer(row.ids, np.int32).tolist(), np.cumsum(np.frombuffer(row.counts, np.int32)).tolist()
        parts = [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return row.piece, np.frombuffer(row.cuts, np.int32).tolist(), parts

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        c, ids = codec(path), []
        rows = rows.sort_values(["seg", "seq"])
        for seg, part in rows.groupby("seg", sort=True):
            if seg:
                ids.append(MARK_ID)
            ids += [i for x in c.tree([unpack(r) for r in part.itertuples() if r.piece])[2] for i in x]
        return pd.DataFrame([[rows["doc_id"].iloc[0], *digests(ids, c.decode(ids))]], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return join


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """doc_id, token count and digests of the ids and of the decoded text, one row a document row.

    A null text counts as empty (no tokens). Repeated rows give repeated results; an empty table gives none.
    Texts of more than ``piece`` code points go through tree concatenation: their pieces are dealt out over all
    tasks and only their encoded neighbours meet again, a document at a time.
    """
    base = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_row")
    long = F.length("text") > piece
    short = base.where(~F.coalesce(long, F.lit(False))).select("doc_id", "text").mapInArrow(_encode_whole(path), DIGESTS)
    segments = base.where(long).select("_row", "doc_id", F.posexplode(F.split("text", "<\\|endoftext\\|>", -1)).alias("seg", "part"))
    # One pass cuts a segment; an empty one, between two marks, is one empty piece.
    cut = F.when(F.col("part") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("part", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    pieces = segments.select("_row", "doc_id", "seg", F.posexplode(cut).alias("seq", "piece"))
    dealt = pieces.repartition("_row", "seg", "seq")
    encoded = dealt.mapInArrow(_encode_pieces(path), "_row long, doc_id long, seg int, seq int, piece string, cuts binary, counts binary, ids binary")
    return short.unionByName(as_many_parts(encoded.groupBy("_row").applyInPandas(_join_pieces(path), DIGESTS), docs))


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` of each document row, for use where the tokens themselves are wanted."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")
