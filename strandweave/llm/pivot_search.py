"""Exact top-k by inner product with a pivot-distance index.

Vectors belong to their nearest pivot and, by their distance to it, to one of its annuli; an annulus of many
vectors is dealt out in chunks. With the distances of a query and a vector to a pivot known, the triangle
inequality bounds their distance from below by the difference, and so their inner product from above by
(|q|^2 + |x|^2 - difference^2) / 2. A query visits only annuli, and inside them only sorted stretches, whose
bound reaches the k-th best score known so far; the first such score comes from a bounded sample.
Equal vectors are one entry that keeps as many ids as a top-k can show, so a hot vector costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import as_many_parts, settle, small
from strandweave.llm.vectors import classes, draw, finish, matrix, pack_ids, packed, query_classes, top_rows

#: Vectors of the sample that gives pivots, annuli and first bounds; pivots; annuli of a pivot.
SAMPLE, PIVOTS, RINGS = 4096, 16, 4
#: Vectors of a chunk; of a sorted stretch inside it; queries of a block.
CHUNK, STRETCH, QUERIES = 4096, 256, 512
SCALE = 1024


def quantised(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m)


class Pivots:
    """Pivots of one vector length, spread by taking the farthest sampled vector next, and their annuli."""

    def __init__(self, sample: np.ndarray):
        self.sample = sample
        chosen = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
        gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(sample)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        self.at = sample[chosen]
        near, far = self.assign(sample)
        cuts = [np.quantile(far[near == p], np.arange(1, RINGS) / RINGS) if (near == p).any() else np.zeros(RINGS - 1) for p in range(len(chosen))]
        self.cuts = np.array(cuts)

    def distances(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (self.at * self.at).sum(1) - 2 * m @ self.at.T))

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(m)
        near = d.argmin(1)
        return near, d[np.arange(len(m)), near]

    def ring(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return (far[:, None] > self.cuts[near]).sum(1)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact also where doubles are not; beyond 64 bits held at their ends."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2.0**53:
        whole = [[int(v) for v in r] for r in c]
        out = [[sum(a * b for a, b in zip(map(int, r), w, strict=True)) for w in whole] for r in q]
        return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in r] for r in out], object)
    return q @ c.T


def _assigner(pivots: dict):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            dims, vecs = b.column(0).to_numpy(), b.column(1).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                m = matrix([vecs[i] for i in at], d)
                near, far = pivots[d].assign(m)
                cols = [near.astype(np.int32), pivots[d].ring(near, far).astype(np.int32), far, (m * m).sum(1)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in b.columns], *map(pa.array, cols)], ["dim", "vec", "ids", "pivot", "ring", "far", "sq"])

    return assign


def _slack(x: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound."""
    return 1e-9 * np.abs(x) + 1e-6


def _prober(pivots: dict, rings: dict, k: int):
    """Blocks of queries for each chunk of each annulus whose bound reaches a query's first k-th best score."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, QUERIES):
            dims, vecs, qids = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                q, p = matrix([vecs[i] for i in at], d), pivots[d]
                known = np.asarray(inner(q, p.sample), float)
                known[(known == (q * q).sum(1)[:, None]) & (((q * q).sum(1)[:, None] - 2 * known + (p.sample * p.sample).sum(1)) == 0)] = -np.inf  # itself
                least = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
                far, sq = p.distances(q), (q * q).sum(1)
                for (pivot, ring), (low, high, most, chunks) in rings.get(d, {}).items():
                    gap = np.maximum(0, np.maximum(low - far[:, pivot], far[:, pivot] - high))
                    bound = (sq + most - gap * gap) / 2
                    go = np.flatnonzero(bound + _slack(sq + most) >= least)
                    if len(go):
                        body = [qids[at[go]].tobytes(), q[go].tobytes(), least[go].tobytes(), np.ascontiguousarray(far[go, pivot]).tobytes()]
                        cols = [[d] * chunks, [pivot] * chunks, [ring] * chunks, list(range(chunks)), *[[x] * chunks for x in body]]
                        kinds = [pa.int32()] * 4 + [pa.binary()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "pivot", "ring", "chunk", "qids", "queries", "least", "q_far"])

    return probe


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("far", kind="stable")
    counts = np.array([len(x) for x in rows["ids"]], np.int64)
    packs = [b"".join(rows["vec"]), pack_ids(np.concatenate(rows["ids"].to_list())), counts.tobytes(), rows["far"].to_numpy().tobytes()]
    return pd.DataFrame([[*rows[["dim", "pivot", "ring", "chunk"]].iloc[0].tolist(), *packs]], columns=["dim", "pivot", "ring", "chunk", "vecs", "ids", "counts", "far"])


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4):
            for r in b.to_pylist():
                c, q = np.frombuffer(r["vecs"]).reshape(-1, r["dim"]), np.frombuffer(r["queries"]).reshape(-1, r["dim"])
                ids, counts, far = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["far"])
                starts = np.cumsum(counts) - counts
                least, q_far, sq, c_sq = np.frombuffer(r["least"]).copy(), np.frombuffer(r["q_far"]), (q * q).sum(1), (c * c).sum(1)
                stretches = [slice(i, i + STRETCH) for i in range(0, len(c), STRETCH)]
                bounds = []
                for s in stretches:
                    gap = np.maximum(0, np.maximum(far[s][0] - q_far, q_far - far[s][-1]))
                    bounds.append((sq + c_sq[s].max() - gap * gap) / 2 + _slack(sq + c_sq[s].max()))
                held = [np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64)]
                for n in np.argsort([-x.max() for x in bounds], kind="stable").tolist():
                    go = np.flatnonzero(bounds[n] >= least)
                    if not len(go):
                        continue
                    score = inner(q[go], c[stretches[n]])
                    cut = least[go]
                    if score.shape[1] > k:
                        cut = np.maximum(cut, np.sort(score, axis=1)[:, -k].astype(float) if score.dtype == object else np.partition(score, -k, axis=1)[:, -k])
                    i, j = np.nonzero(score >= cut[:, None])
                    j0 = j + stretches[n].start
                    value, each = score[i, j], counts[j0]
                    of = np.repeat(starts[j0], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    held = [np.concatenate(x) for x in zip(held, [np.repeat(go[i], each), np.repeat(value, each).astype(object), ids[of]], strict=True)]
                    kept = top_rows(held[0], held[1], held[2], k)
                    held = [x[kept] for x in held]
                    full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) >= k)
                    if len(full):
                        worst = np.full(len(q), np.inf)
                        np.minimum.at(worst, held[0], held[1].astype(float))
                        least[full] = np.maximum(least[full], worst[full])
                qids = np.frombuffer(r["qids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(qids[held[0]]), pa.array(held[2]), pa.array([int(x) for x in held[1]], pa.int64())], ["qid", "vec_id", "score"])

    return search


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best by inner product of ``floor(1024 * x)``, exactly.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own, of
    the same length. Ties go to the smaller vec_id. Vectors that are null, empty or hold a null or non-finite
    component, and rows without vec_id, take no part; repeated rows count once. An empty table gives no row.
    Products past 64 bits are held at the largest long.
    """
    spark = vectors.sparkSession
    rows = packed(vectors, quantised)
    made = settle(classes(rows, k + 1))
    pivots = {d: Pivots(m) for d, m in draw(made, SAMPLE).items()}
    whole = settle(made.mapInArrow(_assigner(pivots), "dim int, vec binary, ids array<long>, pivot int, ring int, far double, sq double"))
    # At most pivots times annuli rows for each length of vectors come to the driver.
    rings: dict[int, dict] = {}
    for r in whole.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("sq").alias("most")).collect():
        rings.setdefault(r["dim"], {})[r["pivot"], r["ring"]] = (r["low"], r["high"], r["most"], -(-r["n"] // CHUNK))
    queries, members = query_classes(rows, every)
    blocks = settle(queries.select("dim", "vec", "qid").mapInArrow(_prober(pivots, rings, k), "dim int, pivot int, ring int, chunk int, qids binary, queries binary, least binary, q_far binary"))
    chunks = spark.createDataFrame([(d, p, r, x[3]) for d, own in rings.items() for (p, r), x in own.items()], "dim int, pivot int, ring int, chunks int")
    dealt = whole.join(F.broadcast(chunks), ["dim", "pivot", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int")).drop("chunks")
    keys = ["dim", "pivot", "ring", "chunk"]
    packs = dealt.groupBy(*keys).applyInPandas(_pack, "dim int, pivot int, ring int, chunk int, vecs binary, ids binary, counts binary, far binary")
    found = blocks.join(packs, keys).mapInArrow(_searcher(k + 1), "qid long, vec_id long, score long")
    return as_many_parts(finish(found, members, k), vectors)


#: Every query against every row; doubles hold these whole numbers exactly.
ORACLE = f"""
with v as (
  select distinct vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score
  from v q join v on q.vec_id <> v.vec_id and len(q.x) = len(v.x) where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 10
"""
