"""Groups of texts with similar sets of word shingles, checked on the texts themselves.

Two texts link if the Jaccard similarity of their sets of ``SHINGLE``-word shingles is ``SIMILAR`` or more. Equal
sets are one node. The first candidates are those of the fingerprints in ``simhash``. Among nodes that these leave apart,
candidates share one of ``BANDS`` keys, each of ``ROWS`` minima of the set under different hashes: two sets of
similarity s share none with a chance of ``(1 - s ** ROWS) ** BANDS``, 3 in a million at 0.8. Sizes and parity
bitmaps rule most of the false ones out: sets whose bitmaps differ in more bits than similar sets of their sizes have
elements apart are no link. All that is left is computed exactly on the texts. Keys with few nodes give all their pairs.
In the others all nodes are compared with a center, the node that shares most keys with others: of a text and its copies
the one most of them are close to. What is then not in the key's largest component is compared with all nodes of other
components, chunk by chunk, in the same two steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import PART_ROWS, TEXT_BYTES, batches_of, join_small, settle, small
from strandweave.operators.graph import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
#: Nodes of a key up to which all its pairs are compared at once; nodes of a chunk of a larger one.
FEW, CHUNK = 8, 512
#: Bits of the smallest and of the largest parity bitmap.
LEAST_BITS, MOST_BITS = 256, 1 << 15
#: Shingles hashed at a time.
BLOCK = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text with fewer words is one shingle, one with none has no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    spans, digest = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True), xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in spans), np.uint64, len(words) - k + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed keys of a set; none for the empty one."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        low = np.minimum(low, (hashes[at : at + BLOCK, None] * _FACTORS).min(0))
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), n) for n, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap, as bytes, of which places an odd number of hashes fall on; about four places a hash.

    Two such bitmaps differ in no more bits than their sets have elements apart, also when the longer is folded.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(hashes)).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1)


def _sketcher(fingerprint: Callable[[np.ndarray], int]):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            same, keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))
            size, bits = pa.array(list(map(len, sets)), pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary())
            fp = pa.array(np.array(list(map(fingerprint, sets)), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), same, keys, size, bits, fp], ["_row", "doc_id", "same", "keys", "size", "bits", "fp"])

    return sketches


def shingle_sets(docs: DataFrame, fingerprint: Callable[[np.ndarray], int], rows: int | None = None) -> DataFrame:
    """The distinct sets: ``node`` (a row of it), ``keys``, ``size``, ``bits``, ``fp`` and the ``best`` of its rows.

    ``docs`` has ``_row``, ``doc_id`` and ``text`` and gives the same rows whenever it is read. Here and below ``rows``, their
    number, says how many files tables are settled to; nothing else depends on it.
    """
    made = docs.select("_row", "doc_id", "text").mapInArrow(_sketcher(fingerprint), "_row long, doc_id long, same binary, keys array<long>, size long, bits binary, fp long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best")
    one = F.min(F.struct("_row", "keys", "size", "bits", "fp")).alias("x")
    sets = made.groupBy("same").agg(one, best).select(F.col("x._row").alias("node"), "x.keys", "x.size", "x.bits", "x.fp", "best")
    with batches_of(docs.sparkSession, TEXT_BYTES):
        return settle(sets, rows, PART_ROWS)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, hashes = None, None
    for b in small(batches):
        ok = []
        for one, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if one != last:  # pairs come sorted by their first node
                last, hashes = one, shingle_set(x)
            ok.append(similarity(hashes, shingle_set(y)) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps differ in no more bits than similar sets of their sizes have elements apart."""
    for b in small(batches):
        both = b.column(2).to_numpy() + b.column(3).to_numpy()
        apart = []
        for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
            words = min(x.shape[1], y.shape[1])
            apart.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()))
        ok = np.array(apart, np.int64) <= both * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9
        yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok))


def verified(nodes: DataFrame, docs: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose texts are similar; only those are read whose sizes and bitmaps allow it."""
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    about = [nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    known = pairs.select(least, most).distinct().join(about[0], "a").join(about[1], "b")
    near = known.where(F.least("size_a", "size_b") >= SIMILAR * F.greatest("size_a", "size_b") - 1e-9)
    with batches_of(nodes.sparkSession, TEXT_BYTES):
        pairs = settle(near.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(_hopeful, "a long, b long"), rows, PART_ROWS)
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows)
    texts = join_small(docs.select(F.col("_row").alias("node"), "text"), ids, "node", "left_semi", ids.count())
    named = [texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    beside = pairs.join(named[1], "b").join(named[0], "a")
    with batches_of(texts.sparkSession, TEXT_BYTES):
        return settle(beside.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long"), rows, PART_ROWS)


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Nodes, roots and sizes of a chunk, and by length of bitmap its places and bitmaps as rows of words."""
    rows = column.values.slice(column.offsets[0].as_py(), column.offsets[1].as_py() - column.offsets[0].as_py())
    node, root, size = (rows.field(n).to_numpy(zero_copy_only=False) for n in ("node", "root", "size"))
    bits = rows.field("bits").to_pylist()
    lengths = np.array(list(map(len, bits)))
    return node, root, size, {n: (at := np.flatnonzero(lengths == n), np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)) for n in np.unique(lengths).tolist()}


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two chunks' nodes, of different components, whose sizes and bitmaps allow them to be similar."""
    for b in small(batches, 1):
        main = b.column(0)[0].as_py()
        (x, root_x, size_x, bits_x), (y, root_y, size_y, bits_y) = _members(b.column(1)), _members(b.column(2))
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for n, (at, rows) in bits_x.items():
            for m in (n // 2, n, 2 * n):  # others are too different in size
                if m not in bits_y:
                    continue
                to, others = bits_y[m]
                words = min(n, m) // 8
                left, right, both = _folded(rows, words), _folded(others, words), size_x[at][:, None] + size_y[to]
                apart = np.zeros(both.shape, np.int64)
                for w in range(words):
                    apart += np.bitwise_count(left[:, w, None] ^ right[:, w])
                least, most = np.minimum(size_x[at][:, None], size_y[to]), np.maximum(size_x[at][:, None], size_y[to])
                ok = (apart <= both * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9) & (least >= SIMILAR * most - 1e-9)
                ok &= (root_x[at][:, None] != root_y[to]) & ((root_y[to] == main) | (x[at][:, None] < y[to]))
                i, j = np.nonzero(ok)
                out[0].append(x[at[i]]), out[1].append(y[to[j]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b"])


def _links(nodes: DataFrame, docs: DataFrame, members: DataFrame, known: DataFrame, rows: int | None) -> DataFrame:
    """Links ``a``, ``b`` that connect nodes just as the ``known`` and all links among those of an equal key do.

    ``members`` has ``key``, its ``n``, ``node`` and the ``root`` of what is known of it.
    """
    few, many = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    held = many.count()
    left, right = few.select("key", F.col("node").alias("a"), F.col("root").alias("root_a")), few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = left.join(right, "key").where("a < b and root_a <> root_b").select("a", "b")
    if held:
        weight = many.groupBy("node").agg(F.sum("n").alias("weight"))
        most = F.max_by(F.struct("node", "root"), F.struct("weight", "node")).alias("x")
        centers = many.join(weight, "node").groupBy("key").agg(most).select("key", F.col("x.node").alias("center"), F.col("x.root").alias("center_root"))
        pairs = pairs.union(many.join(centers, "key").where("root <> center_root").select("center", "node"))
    links = known.union(verified(nodes, docs, pairs, rows))
    if not held:
        return links
    here = many.drop("root").join(components(links, rows), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = here.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    todo = here.join(keys.select("key", "m", F.col("most.root").alias("main"), F.col("most.c").alias("c")), "key").join(nodes.select("node", "size", "bits"), "node")
    todo = settle(todo, rows, PART_ROWS)

    def chunks(of: DataFrame, count, name: str) -> DataFrame:
        dealt = of.withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(count / CHUNK)))
        return dealt.groupBy("key", "main", "chunk").agg(F.collect_list(F.struct("node", "root", "size", "bits")).alias(name)).drop("chunk")

    rest = chunks(todo.where("root <> main"), F.col("m") - F.col("c"), "rest")
    near = rest.join(chunks(todo, F.col("m"), "others").drop("main"), "key").select("main", "rest", "others").mapInArrow(_near, "a long, b long")
    return links.union(verified(nodes, docs, near, rows))


def first_rows(nodes: DataFrame, docs: DataFrame, known: DataFrame, rows: int | None = None) -> DataFrame:
    """``_row`` of one document of each group of similar texts: that with the smallest doc_id, null being the last.

    ``nodes`` are the ``shingle_sets`` of ``docs``; ``known`` are links ``a``, ``b`` among them, found before. Only keys
    whose nodes these don't connect are looked into. Texts that are null or have no word are one group.
    """
    found = settle(components(known, rows), rows)
    near = nodes.select("node", "keys").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    apart = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = settle(near.join(apart.select("key", "n"), "key"), rows, PART_ROWS)
    stars = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(_links(nodes, docs, members, stars, rows), rows)
    named = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return named.select(F.col("best._row").alias("_row"))
