"""Vector codes: each of four parts of a vector becomes the index of the nearest entry of its codebook.

Vectors are whole numbers, ``floor(1024 * x)``. All distances of a batch to a codebook come from one float32
matrix product, each with an interval that holds the true value whatever the rounding. Only entries whose
interval reaches below the least upper end are computed again, in whole numbers; of equal distances the lowest
index wins. A round of learning adds up parts by entry inside each task, then by entry over all tasks; the
codebooks, 256 entries of each part, are all that comes to the driver. Vectors are never shuffled or grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import join_small, settle, small

#: Scale of the whole numbers; parts of a vector; entries of a codebook; rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a matrix product; numbers that are computed again at a time.
BLOCK, AGAIN = 2048, 1 << 20
#: Whole numbers are held within this, the largest double below 2^63.
MOST = (1 << 63) - 1024
LONG = (1 << 63) - 1


def _width(dim: int) -> int:
    """Components of a vector whose parts are equal: zeros fill up the last part."""
    return -(-dim // PARTS) * PARTS


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, ``dim`` and ``vec`` (whole numbers as bytes, 2, 4 or 8 of them each) of the rows that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                m = np.zeros((len(at), _width(dim)))
                with np.errstate(over="ignore"):
                    m[:, :dim] = np.floor(SCALE * flat[starts[at][:, None] + np.arange(dim)])
                ok = np.isfinite(m).all(1)
                m = np.clip(m[ok], -MOST, MOST).astype(np.int64)
                most = np.abs(m).max(initial=0)
                m = m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
                ids, labels = (b.column(i).take(pa.array(at[ok])) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([dim] * len(m), pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "label", "dim", "vec"])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(pack, f"vec_id long, label {kind}, dim int, vec binary")


def unpack(vecs: list[bytes], dim: int) -> np.ndarray:
    """The int64 matrix of packed vectors of one length."""
    width = _width(dim)
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    if not width:
        return np.zeros((len(vecs), 0), np.int64)
    out = np.empty((len(vecs), width), np.int64)
    size = np.array([len(v) // width for v in vecs])
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        out[at] = np.frombuffer(b"".join([vecs[i] for i in at]), kinds[s]).reshape(-1, width)
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exactly; in Python's integers where they may pass 64 bits."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * x.shape[1] > LONG:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(1)


def interval(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends for |c|^2 - 2 x.c, from a float32 product.

    Turned into float32, a component errs by a factor within 1 + u (u = 2^-24), and a sum of n products by
    n roundings more at most, in whatever order they are added. So the product errs by g |x| |c| at most, with
    g = (n + 2) u / (1 - (n + 2) u), as the sum of |x_i c_i| is at most |x| |c|. What is left is done in doubles,
    whose own errors are far below the second term. A value that is not finite has no bounds.
    """
    n = x.shape[1]
    u = (n + 2) * 2.0**-24
    if u > 0.5:
        return np.full((len(x), len(c)), -np.inf), np.full((len(x), len(c)), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(float)
        a, b = x.astype(float), c.astype(float)
        square = (b * b).sum(1)
        size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt(square)
        value = square - 2 * product
        slack = 2.01 * u / (1 - u) * size + (n + 8) * 2.0**-52 * (square + 2 * size)
        low, high = value - slack, value + slack
    open_ = ~(np.isfinite(low) & np.isfinite(high))
    low[open_], high[open_] = -np.inf, np.inf
    return low, high


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equally near ones, and its squared distance."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first = np.unique(c, axis=0, return_index=True) if c.shape[1] else (None, np.zeros(1, np.int64))
    first = np.sort(first)  # of equal entries only the lowest can win
    index, distance = [], []
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        low, high = interval(part, c[first])
        i, j = np.nonzero(low <= high.min(1)[:, None])
        step = max(1, AGAIN // max(1, x.shape[1]))
        exact = [squared(part[i[s : s + step]], c[first[j[s : s + step]]]) for s in range(0, len(i), step)]
        d = exact[0] if len(exact) == 1 else np.concatenate([e.astype(object) for e in exact] if any(e.dtype == object for e in exact) else exact)
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        best = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == best[i])
        index.append(first[j[hit[np.unique(i[hit], return_index=True)[1]]]])
        distance.append(best)
    if any(d.dtype == object for d in distance):
        distance = [d.astype(object) for d in distance]
    return np.concatenate(index), np.concatenate(distance)


Books = dict[int, list[np.ndarray]]


def _parts(m: np.ndarray) -> list[np.ndarray]:
    return np.split(m, PARTS, axis=1)


def _by_length(b: pa.RecordBatch, dims: str, vecs: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length in a batch."""
    dim, vec = b.column(dims).to_numpy(), b.column(vecs)
    for d in np.unique(dim).tolist():
        at = np.flatnonzero(dim == d)
        yield d, at, unpack(vec.take(pa.array(at)).to_pylist(), d)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a task's smallest vec_ids, of equal ids the least bytes."""
    kept: dict[int, dict[int, bytes]] = {}
    for b in batches:
        for d, i, v in zip(*(b.column(n).to_pylist() for n in ("dim", "vec_id", "vec")), strict=True):
            own = kept.setdefault(d, {})
            if i is not None:
                own[i] = min(v, own.get(i, v))
            if len(own) > 4 * ENTRIES:
                kept[d] = {k: own[k] for k in sorted(own)[:ENTRIES]}
    for d, own in kept.items():
        ids = sorted(own)[:ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([own[i] for i in ids], pa.binary())], ["dim", "vec_id", "vec"])


def first_books(rows: DataFrame) -> Books:
    """Codebooks of the smallest vec_ids of each length; without any vec_id a codebook is one entry of zeros."""
    order = Window.partitionBy("dim").orderBy("vec_id")
    once = rows.mapInArrow(_firsts, "dim int, vec_id long, vec binary").groupBy("dim", "vec_id").agg(F.min("vec").alias("vec"))
    chosen: dict[int, list[bytes]] = {r["dim"]: [] for r in rows.select("dim").distinct().collect()}
    for r in once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ENTRIES).orderBy("dim", "vec_id").collect():
        chosen[r["dim"]].append(bytes(r["vec"]))
    return {d: _parts(unpack(v, d) if v else np.zeros((1, _width(d)), np.int64)) for d, v in chosen.items()}


def _adder(books: Books):
    """Counts of each entry's parts, and sums by component as upper and lower halves, which no batch can overflow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in small(batches, 1 << 16):
            for d, _, m in _by_length(b, "dim", "vec"):
                for p, x in enumerate(_parts(m)):
                    own, _ = nearest(x, books[d][p])
                    size = len(books[d][p])
                    sums = [np.bincount(own, minlength=size)]
                    for column in x.T:
                        sums += [np.bincount(own, half.astype(float), size).astype(np.int64) for half in (column >> 31, column & 0x7FFFFFFF)]
                    made = np.stack(sums, 1)
                    held[d, p] = held[d, p] + made if (d, p) in held else made
        for (d, p), sums in held.items():
            used = np.flatnonzero(sums[:, 0])
            cols = [pa.array([d] * len(used), pa.int32()), pa.array([p] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "part", "entry", "sums"])

    return add


def next_books(rows: DataFrame, books: Books) -> Books:
    """Each entry moved to the mean of its parts, rounded down; unused ones stay."""
    sums = rows.select("dim", "vec").mapInArrow(_adder(books), "dim int, part int, entry int, sums array<long>")
    each = sums.select("dim", "part", "entry", F.posexplode("sums").alias("at", "sum")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    # As many rows as the codebooks have numbers, whatever the table: 2 * 256 a component and 256 counts a part.
    got = {(r["dim"], r["part"], r["entry"], r["at"]): int(r["sum"]) for r in each.collect()}
    out = {d: [b.copy() for b in own] for d, own in books.items()}
    for (d, p, e, at), count in got.items():
        if at == 0:
            for n in range(out[d][p].shape[1]):
                out[d][p][e, n] = ((got[d, p, e, 2 * n + 1] << 31) + got[d, p, e, 2 * n + 2]) // count
    return out


def digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in own for v in b.ravel().tolist()).encode()).hexdigest()


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks by length of vectors, from the rows of ``whole``; these should be settled, as each round reads them."""
    books = first_books(rows)
    for _ in range(rounds):
        books = next_books(rows, books)
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error (held at the largest long) and the digest of the codebooks of each row of ``whole``."""
    digests = {d: digest(own) for d, own in books.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1 << 16):
            for d, at, m in _by_length(b, "dim", "vec"):
                found = [nearest(x, book) for x, book in zip(_parts(m), books[d], strict=True)]
                codes = [bytes(c).hex() for c in np.stack([f[0] for f in found], 1).astype(np.uint8)]
                errors = [min(LONG, sum(map(int, e))) for e in zip(*(f[1] for f in found), strict=True)]
                ids, labels = (b.column(n).take(pa.array(at)) for n in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes), pa.array(errors, pa.int64()), pa.array([digests[d]] * len(at))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row that takes part.

    Left out are vectors that are null or hold a null or non-finite component. Vectors of another length have
    codebooks of their own (lengths are taken to be few); where a length isn't a multiple of four, zeros fill up
    the last part; an empty vector has empty parts, code 00000000 and error 0. A null vec_id starts no codebook but
    is encoded; rows that repeat a vec_id start one entry (of unlike vectors that with the least bytes), and each is
    counted and returned. ``label_error`` adds up errors over equal labels, null being one. Whole numbers are held
    within 2^63 - 1024, errors and their sums at the largest long. An empty table gives no row.
    """
    rows = settle(whole(vectors))
    found = settle(encode(rows, learn(rows, rounds)))
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = settle(sums)
    out = join_small(found, sums, found["label"].eqNullSafe(sums["_label"]), "inner", sums.count())
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Parts as rows, every distance computed, four rounds written out; a vec_id is taken to be there once."""
    text = f"""
with recursive v as (
  select vec_id::bigint as vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (
  select vec_id, label, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] as x from v, range({PARTS}) r(p)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from v order by vec_id limit {ENTRIES}),
book0 as materialized (select p, e, x from part join first using (vec_id)),"""
    near = """
near{n} as materialized (
  select vec_id, label, p, arg_min(e, (d, e)) as e, min(d) as d from (
    select part.vec_id, label, p, e, list_sum(list_transform(list_zip(part.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from part join book{n} b using (p)) group by all),"""
    book = """
book{m} as materialized (
  select b.p, b.e, coalesce(s.x, b.x) as x from book{n} b left join (
    select p, e, list(y order by i) as x from (
      select n.p, n.e, i, floor(sum(part.x[i])::decimal(38,0)::double / count(*))::bigint as y
      from near{n} n join part using (vec_id, p), range(1, 1 + len(part.x)) r(i) group by n.p, n.e, i) group by p, e) s
  on b.p = s.p and b.e = s.e),"""
    for n in range(ROUNDS):
        text += near.format(n=n) + book.format(n=n, m=n + 1)
    return text + near.format(n=ROUNDS) + f"""
code as (
  select vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from near{ROUNDS} group by all),
hash as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select h from hash) as codebooks_sha256 from code
"""


ORACLE = _oracle()
