"""Vectors as packed doubles, equal ones as one class, and top-k lists of classes as top-k lists of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(vectors: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = True) -> DataFrame:
    """vec_id, ``dim`` and ``vec`` (doubles as bytes) of the vectors that take part, repeated rows once.

    Left out are vectors that are null or empty or hold a null or non-finite component, or are zero where
    ``zero`` is false, and rows without a vec_id. ``change`` maps a matrix of vectors of one length.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()]) if lists.null_count else np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                m = flat[starts[at][:, None] + np.arange(dim)]
                ok = np.isfinite(m).all(1) & (zero | (m != 0).any(1))
                m = (change(m[ok]) if change else m[ok]) + 0.0  # one zero, not two
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][ok]), pa.array([dim] * len(m), pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "dim", "vec"])

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(pack, "vec_id long, dim int, vec binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """dim, vec and ``ids``: the k smallest vec_ids of each distinct vector; no more can be among a top k."""
    first = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("dim", "vec").orderBy("vec_id"))).where(F.col("_n") <= k)
    return first.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(vecs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), float).reshape(-1, dim)


def pack_ids(ids) -> bytes:
    return np.asarray(ids, np.int64).tobytes()


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_classes(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """The queries: vectors with a vec_id divisible by ``every``, equal ones once under ``qid``; and who they are."""
    own = rows.where(F.col("vec_id") % every == 0).distinct()
    once = own.groupBy("dim", "vec").agg(F.min("vec_id").alias("qid"))
    return once, own.join(once, ["dim", "vec"]).select("qid", F.col("vec_id").alias("query_id"))


def draw(made: DataFrame, most: int) -> dict[int, np.ndarray]:
    """About ``most`` distinct vectors of each length by hash, all if there are fewer, as matrices.

    Only this sample and one count for each length that occurs come to the driver.
    """
    counts = {r["dim"]: r["count"] for r in made.groupBy("dim").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, int(min(1, most / n) * (1 << 40)))])
    got: dict[int, list] = {}
    for r in made.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) < F.element_at(share, F.col("dim"))).select("dim", "vec").collect():
        got.setdefault(r["dim"], []).append(bytes(r["vec"]))
    return {d: matrix(sorted(v), d) for d, v in sorted(got.items())}


def finish(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query from those of its class, itself left out."""
    top = best(found.withColumnRenamed("qid", "query_id"), k + 1).select(F.col("query_id").alias("qid"), "vec_id", "score")
    return best(members.join(top, "qid").where("vec_id <> query_id"), k)


def top_rows(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: by score, then the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]
