"""Column functions over sequences and their k-mers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: letters of ordinary text as bases, so that text tables can stand in for sequences.
PROJECTION = "ACGTACGTACGTACGTACGTACGTAC"
_PAIRED = str.maketrans("ACGT", "TGCA")


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def normalise(c: Column) -> Column:
    """Upper case, and N for what is no base."""
    return F.regexp_replace(upper_ascii(c), "[^ACGT]", "N")


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def project_dna(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z]", ""), LOWER, PROJECTION)


def name_prefix(c: Column, delimiter: str) -> Column:
    """A name up to its last delimiter; the whole name if it has none."""
    return F.regexp_replace(c, f"\\Q{delimiter}\\E(?:(?!\\Q{delimiter}\\E).)*$", "")


def kmer_hash(c: Column, algorithm: str = "xxhash64") -> Column:
    """64-bit hash of a k-mer as a long whose order is that of the unsigned value.

    ``md5_60`` is shared with other SQL engines, ``xxhash64`` the fast default, ``murmur3`` the hash (x64, 128 bits,
    seed 42, low half) of existing index files.
    """
    if algorithm == "md5_60":
        return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
    if algorithm == "xxhash64":
        return F.xxhash64(c)
    return _murmur_udf(c)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def murmur3_low64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """Low half of the public 128-bit hash of each row of a byte matrix."""
    # Fixed values of the public hash function.
    c1, c2, f1, f2 = (np.uint64(v) for v in (0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
    n, length = rows.shape
    h1 = np.full(n, seed, np.uint64)
    h2 = h1.copy()
    body = np.zeros((n, -(-length // 16) * 16), np.uint8)
    body[:, :length] = rows
    words = body.view("<u8")
    whole = length // 16
    with np.errstate(over="ignore"):
        for b in range(whole):
            k1, k2 = words[:, 2 * b], words[:, 2 * b + 1]
            h1 = (_rotl(h1 ^ (_rotl(k1 * c1, 31) * c2), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 = (_rotl(h2 ^ (_rotl(k2 * c2, 33) * c1), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        rest = length - 16 * whole
        if rest > 8:
            h2 = h2 ^ (_rotl(words[:, 2 * whole + 1] * c2, 33) * c1)
        if rest:
            h1 = h1 ^ (_rotl(words[:, 2 * whole] * c1, 31) * c2)
        h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
        h1 = h1 + h2
        h2 = h2 + h1
        mixed = []
        for h in (h1, h2):
            h = (h ^ (h >> np.uint64(33))) * f1
            h = (h ^ (h >> np.uint64(33))) * f2
            mixed.append(h ^ (h >> np.uint64(33)))
        return mixed[0] + mixed[1]


#: K-mers hashed together.
HASHED = 1 << 16


def xxhash64_rows(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """The public 64-bit hash of each row of a byte matrix."""
    # Fixed values of the public hash function.
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    n, length = rows.shape
    body = np.zeros((n, -(-length // 8) * 8), np.uint8)
    body[:, :length] = rows
    words = body.view("<u8")
    mixed = lambda acc, word: _rotl(acc + word * p2, 31) * p1
    with np.errstate(over="ignore"):
        start, at = np.uint64(seed), length // 32 * 4
        if at:
            lanes = [np.full(n, v, np.uint64) for v in (start + p1 + p2, start + p2, start, start - p1)]
            for w in range(at):
                lanes[w % 4] = mixed(lanes[w % 4], words[:, w])
            h = sum((_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True)), np.uint64(0))
            for v in lanes:
                h = (h ^ mixed(np.uint64(0), v)) * p1 + p4
        else:
            h = np.full(n, start + p5, np.uint64)
        h = h + np.uint64(length)
        for w in range(at, length // 8):
            h = _rotl(h ^ mixed(np.uint64(0), words[:, w]), 27) * p1 + p4
        done = length // 8 * 8
        if length - done >= 4:
            h = _rotl(h ^ (words[:, done // 8] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
            done += 4
        for c in range(done, length):
            h = _rotl(h ^ body[:, c].astype(np.uint64) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


#: Bytes of a row that md5 takes as one block with its end mark and length.
MD5_BYTES = 55
#: Rows that md5 takes together: their words stay in the cache.
MD5_ROWS = 1 << 13


def md5_60_rows(rows: np.ndarray) -> np.ndarray:
    """The first 60 bits of md5 of each row of a byte matrix; a row has at most ``MD5_BYTES``."""
    n, length = rows.shape
    out = np.empty(n, np.uint64)
    # Fixed values of the public hash function.
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    places = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
    added = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for lo in range(0, n, MD5_ROWS):
        part = rows[lo : lo + MD5_ROWS]
        body = np.zeros((len(part), 64), np.uint8)
        body[:, :length] = part
        body[:, length] = 0x80
        used = {w: np.ascontiguousarray(body[:, 4 * w : 4 * w + 4]).view("<u4").ravel() for w in range(length // 4 + 1)}
        a, b, c, d = (np.full(len(part), v) for v in start)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            step, w = i // 16, places[i // 16](i)
            if step == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif step == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif step == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:  # c ^ (b | ~d)
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            a += f
            a += np.uint32((added[i] + (8 * length if w == 14 else 0)) & 0xFFFFFFFF)
            if w in used:
                a += used[w]
            turn = turns[step][i % 4]
            np.left_shift(a, np.uint32(turn), out=t)
            a >>= np.uint32(32 - turn)
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        a += start[0]
        b += start[1]
        out[lo : lo + MD5_ROWS] = (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4)).astype(np.uint64)
    return out


@F.pandas_udf(T.LongType())
def _murmur_udf(kmers: pd.Series) -> pd.Series:
    raw = [x.encode() if x is not None else b"" for x in kmers]
    out = np.zeros(len(raw), np.uint64)
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = murmur3_low64(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size))
    return pd.Series((out ^ np.uint64(1 << 63)).view(np.int64))


def fragments(sequences: DataFrame, length: int, k: int, split: bool = True) -> DataFrame:
    """seq_id, frag_no, frag_start, frag and full_len: consecutive segments, and one that ends with the sequence.

    A sequence no longer than a segment, or any if ``split`` is off, is one fragment; those shorter than ``k`` are
    dropped. Segments are cut in one pass over the sequence, whatever its length.
    """
    rows = sequences.select("seq_id", "seq", F.length("seq").cast("long").alias("full_len")).where(F.col("full_len") >= k)
    one = F.array(F.struct(F.lit(0).cast("long").alias("frag_start"), F.col("seq").alias("frag")))
    if split:
        parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{{length}}}"), F.lit(0))
        cut = F.transform(parts, lambda x, i: F.struct((i * length).cast("long").alias("frag_start"), x.alias("frag")))
        start = F.col("full_len") - length
        tail = F.array(F.struct(start.alias("frag_start"), F.substr("seq", (start + 1).cast("int"), F.lit(length)).alias("frag")))
        many = F.when(F.col("full_len") % length > 0, F.concat(cut, tail)).otherwise(cut)
        one = F.when(F.col("full_len") <= length, one).otherwise(many)
    made = rows.select("seq_id", "full_len", F.posexplode(one).alias("frag_no", "f"))
    return made.select("seq_id", "frag_no", "f.frag_start", "f.frag", "full_len")


def kmers(frags: DataFrame, k: int, algorithm: str = "xxhash64", alphabet: str = "dna") -> DataFrame:
    """Each k-mer of each fragment: hash (the smaller of both strands), strand and place.

    Palindromes and k-mers with N are dropped for DNA; text has one strand.
    """
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("frag") - k + 1), lambda i: F.substr("frag", i, F.lit(k))))
    rows = frags.where(F.length("frag") >= k).select("seq_id", "frag_no", "frag_start", at.alias("pos", "kmer"))
    place = (F.col("frag_start") + F.col("pos")).alias("pos")
    if alphabet == "text":
        return rows.select("seq_id", "frag_no", place, kmer_hash(F.col("kmer"), algorithm).alias("hash"), F.lit(1).alias("strand"))
    rows = rows.where(~F.col("kmer").contains("N"))
    rows = rows.select("seq_id", "frag_no", place, kmer_hash(F.col("kmer"), algorithm).alias("f"), kmer_hash(reverse_complement(F.col("kmer")), algorithm).alias("r"))
    return rows.where("f <> r").select("seq_id", "frag_no", "pos", F.least("f", "r").alias("hash"), F.when(F.col("f") < F.col("r"), 1).otherwise(-1).alias("strand"))


def _word_hashes(text: str, k: int, algorithm: str) -> np.ndarray:
    """Signed hashes of all k-mers of a text, the same as ``kmer_hash`` gives."""
    n = len(text) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if algorithm == "md5_60" and 4 * k > MD5_BYTES:
        plain = raw.tobytes()
        starts = np.flatnonzero((raw & 0xC0) != 0x80).tolist() + [len(plain)]
        return np.fromiter((int(hashlib.md5(plain[i:j]).hexdigest()[:15], 16) for i, j in zip(starts, starts[k:], strict=False)), np.int64, n)
    rows_hash = {"md5_60": md5_60_rows, "xxhash64": xxhash64_rows, "murmur3": murmur3_low64}[algorithm]
    out = np.empty(n, np.uint64)
    if len(raw) == len(text):
        for at in range(0, n, HASHED):
            out[at : at + HASHED] = rows_hash(np.lib.stride_tricks.sliding_window_view(raw[at : at + HASHED + k - 1], k))
    else:  # k-mers of equal length in bytes at a time
        starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        sizes = starts[k:] - starts[:-k]
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            for at in range(0, len(same), HASHED):
                part = same[at : at + HASHED]
                out[part] = rows_hash(raw[starts[part][:, None] + np.arange(size)])
    return (out ^ np.uint64(1 << 63) if algorithm == "murmur3" else out).view(np.int64)


def hashed(text: str, k: int, algorithm: str = "xxhash64", alphabet: str = "dna") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, strand and whether it counts (no palindrome, no N) of each k-mer of a text, for use inside tasks.

    All k-mers of a text are hashed together, by columns of bytes; many short texts are best joined first.
    """
    forward = _word_hashes(text, k, algorithm)
    if alphabet == "text":
        return forward, np.ones(len(forward), np.int64), np.ones(len(forward), bool)
    back = _word_hashes(text[::-1].translate(_PAIRED), k, algorithm)[::-1]
    masked = np.cumsum(np.r_[0, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == ord("N")])
    clean = masked[k:] == masked[: len(masked) - k] if len(forward) else np.empty(0, bool)
    return np.minimum(forward, back), np.where(forward < back, 1, -1), clean & (forward != back)


def hashed_each(texts: list[str], k: int, algorithm: str = "xxhash64", alphabet: str = "dna") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hashed`` of each text, short ones joined: k-mers that reach from one into the next are left out."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= HASHED):
            size += len(texts[end])
            end += 1
        made, start = hashed("".join(texts[at:end]), k, algorithm, alphabet), 0
        for text in texts[at:end]:
            yield tuple(x[start : start + max(0, len(text) - k + 1)] for x in made)
            start += len(text)
        at = end


def _py_kmers(text: str, k: int) -> Iterator[tuple[int, str]]:
    return ((i, text[i : i + k]) for i in range(len(text) - k + 1))


def register(spark) -> None:
    """Make ``kmers(seq, k)`` a table function and ``revcomp`` and ``normalise_dna`` functions of SQL."""

    @F.udtf(returnType=T.StructType().add("pos", T.LongType()).add("kmer", T.StringType()))
    class Kmers:
        def eval(self, seq: str, k: int):
            yield from _py_kmers(seq or "", k)

    spark.udtf.register("kmers", Kmers)
    spark.sql("create or replace temporary function revcomp(s string) returns string return reverse(translate(s, 'ACGT', 'TGCA'))")
    spark.sql("create or replace temporary function normalise_dna(s string) returns string return regexp_replace(upper(s), '[^ACGT]', 'N')")
