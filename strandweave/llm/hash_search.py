"""Approximate nearest neighbours by multi-index hashing.

Unit vectors get binary codes: signs after rotations that are learned, on a bounded sample, to lie close to the
sample's own signs. A code is split into substrings and each is indexed by its value. Two codes that differ in at
most r bits agree to r / substrings bits, rounded down, in some substring; probing all values that close to the
query's in every substring therefore retrieves every code within the radius. Those are checked in full and
reranked by the cosine of the original vectors. Each query's radius follows from the k-th best cosine in the
sample: nearer vectors differ in about acos(cosine) / pi of all bits, and the radius leaves room for the spread.
Rows are dealt over blocks by hash, each with an index of its own; every block is probed for every query, so all
rows are indexed and none is out of reach. Equal vectors are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import as_many_parts, settle, small
from strandweave.llm.vectors import classes, draw, finish, matrix, pack_ids, packed, query_classes, top_rows

#: Vectors of the sample; bits of a code and of a substring; steps of learning a rotation; spreads of room.
SAMPLE, BITS, PART, STEPS, ROOM = 8192, 256, 16, 15, 2.5
#: Vectors of a block and queries of a block.
BLOCK, QUERIES = 16_384, 512
#: Flipped bits up to which the values near a query's are listed; beyond, the occupied values are tested.
LISTED = 2

_FLIPS = [np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(PART), n)], np.uint16) for t in range(LISTED + 1)]


class Coder:
    """Learned codes for vectors of one length, and the sample."""

    def __init__(self, sample: np.ndarray):
        self.sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng, d = np.random.default_rng(0), sample.shape[1]
        turns, bits = [], 0
        while bits < BITS:
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(STEPS if len(sample) >= d else 0):
                u, _, v = np.linalg.svd(self.sample.T @ np.sign(self.sample @ turn))
                turn = u @ v
            turns.append(turn)
            bits += d
        self.turn = np.concatenate(turns, axis=1)[:, :BITS]

    def codes(self, m: np.ndarray) -> np.ndarray:
        return np.packbits(m @ self.turn > 0, axis=1).view(np.uint64)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision on the vectors as they are."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        out = (c @ q) / (np.linalg.norm(q) * np.linalg.norm(c, axis=1))
    bad = ~np.isfinite(out)
    if bad.any():
        out[bad] = unit(c[bad]) @ unit(q[None])[0]
    return out


def _prober(coders: dict, blocks: int, k: int):
    """Blocks of queries with codes and radii, for each block of vectors."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, QUERIES):
            dims, vecs, qids = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                q, coder = matrix([vecs[i] for i in at], d), coders[d]
                u = unit(q)
                known = u @ coder.sample.T
                known[known > 1 - 1e-12] = -1  # itself
                best = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -1.0)
                share = np.arccos(np.clip(best, -1, 1)) / np.pi
                radius = np.minimum(BITS, np.ceil(BITS * share + ROOM * np.sqrt(BITS * share * (1 - share)) + 1)).astype(np.int64)
                radius[best <= -1] = BITS
                body = [qids[at].tobytes(), q.tobytes(), coder.codes(u).tobytes(), radius.tobytes()]
                cols = [[d] * blocks, list(range(blocks)), *[[x] * blocks for x in body]]
                kinds = [pa.int32()] * 2 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "block", "qids", "queries", "q_codes", "radius"])

    return probe


def _packer(coders: dict):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["dim"].iloc[0])
        m = matrix(rows["vec"], d)
        counts = np.array([len(x) for x in rows["ids"]], np.int64)
        packs = [b"".join(rows["vec"]), pack_ids(np.concatenate(rows["ids"].to_list())), counts.tobytes(), coders[d].codes(unit(m)).tobytes()]
        return pd.DataFrame([[d, int(rows["block"].iloc[0]), *packs]], columns=["dim", "block", "vecs", "ids", "counts", "codes"])

    return pack


class Index:
    """The substring indexes of one block: for each substring the values that occur and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, []
        for column in codes.view(np.uint16).reshape(len(codes), -1).T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.parts.append((values, np.append(first, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits: all of them, by pigeonhole."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        flips, seen = radius // len(self.parts), np.zeros(len(self.codes), bool)
        for (values, first, order), own in zip(self.parts, code.view(np.uint16), strict=True):
            if flips <= LISTED:
                probes = own ^ _FLIPS[flips]
                at = np.searchsorted(values, probes)
                at = at[at < len(values)]
                at = at[np.isin(values[at], probes)]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ own) <= flips)
            size = first[at + 1] - first[at]
            seen[order[np.repeat(first[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in small(batches, 4):
            for r in b.to_pylist():
                c, q = np.frombuffer(r["vecs"]).reshape(-1, r["dim"]), np.frombuffer(r["queries"]).reshape(-1, r["dim"])
                ids, counts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64)
                starts = np.cumsum(counts) - counts
                if last[0] != (r["dim"], r["block"]):
                    last = ((r["dim"], r["block"]), Index(np.frombuffer(r["codes"], np.uint64).reshape(len(c), -1)))
                codes, radius = np.frombuffer(r["q_codes"], np.uint64).reshape(len(q), -1), np.frombuffer(r["radius"], np.int64)
                out: list[list] = [[np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]]
                for n in range(len(q)):
                    rows = last[1].within(codes[n], int(radius[n]))
                    score = cosine(q[n], c[rows])
                    if len(rows) > k:
                        near = score >= np.partition(score, -k)[-k]
                        rows, score = rows[near], score[near]
                    each = counts[rows]
                    of = np.repeat(starts[rows], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    for x, y in zip(out, (np.full(len(of), n), np.repeat(score, each), ids[of]), strict=True):
                        x.append(y)
                query, score, found = map(np.concatenate, out)
                kept = top_rows(query, score, found, k)
                qids = np.frombuffer(r["qids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(qids[query[kept]]), pa.array(found[kept]), pa.array(score[kept])], ["qid", "vec_id", "score"])

    return search


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of each query's k nearest found; scores are exact.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own, of
    the same length. Ties go to the smaller vec_id. Vectors that are null, empty, zero or hold a null or non-finite
    component, and rows without vec_id, take no part; repeated rows count once. An empty table gives no row.
    Where the sample holds too few vectors for a radius, every code is within it and the search is exact.
    """
    spark = vectors.sparkSession
    rows = packed(vectors, zero=False)
    made = settle(classes(rows, k + 1))
    count = made.count()
    coders = {d: Coder(m) for d, m in draw(made, SAMPLE).items()}
    blocks = max(1, -(-count // BLOCK))
    queries, members = query_classes(rows, every)
    probes = settle(queries.select("dim", "vec", "qid").mapInArrow(_prober(coders, blocks, k), "dim int, block int, qids binary, queries binary, q_codes binary, radius binary"))
    dealt = made.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int"))
    packs = dealt.groupBy("dim", "block").applyInPandas(_packer(coders), "dim int, block int, vecs binary, ids binary, counts binary, codes binary")
    found = probes.join(packs, ["dim", "block"]).mapInArrow(_searcher(k + 1), "qid long, vec_id long, score double")
    return as_many_parts(finish(found, members, k), vectors)
