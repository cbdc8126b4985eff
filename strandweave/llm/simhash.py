"""SimHash near-duplicates: fingerprints of word shingles, linked through a pigeonring filter.

Two 64-bit fingerprints link at ``RADIUS`` or fewer differing bits. Their bits form a ring of ``SEGMENTS``
segments. If the total is within the radius, there is a start on the ring from which every chain of
consecutive segments holds at most its share of the radius, rounded down (l segments: ``l * RADIUS // SEGMENTS``).
So the first segment is equal, and those after it hold few differences; of their halves enough are equal
to serve as an exact join key. Keys are grouped, and within a key only pairs whose chains all stay within
their shares go on to the full check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import near_texts
from strandweave.llm.common import PART_ROWS, ROW, as_many_parts, parts, settle, small, with_row_id
from strandweave.operators.graph import components

RADIUS = 4
SEGMENTS = 5
#: The same for the sets of shingles of ``first_of_each``, which also asks the texts.
SET_RADIUS = 7
SET_SEGMENTS = 8
#: Nodes up to which their chains have 3 segments: 40 keys, and a thousand nodes a key at most where all are unrelated.
SET_NODES = 1 << 26
SHINGLE = 4
SEED = 42
#: A fingerprint of at least this share of all rows is hot: its rows aren't shuffled, and there are at most HOT such fingerprints.
HOT = 1000
#: Shingles hashed at a time, so that a very long text needs bounded memory beside itself.
BLOCK = 200_000

#: Fingerprints of a key up to which all pairs are looked over at once for any within the radius.
AT_ONCE = 512

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _counted(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    parts = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(parts[:, byte], minlength=256) @ _BITS for byte in range(8)])


def _majority(counts: np.ndarray, n: int) -> int:
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def set_fingerprint(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of a set of hashed shingles; 0 for the empty one."""
    return _majority(_counted(hashes), len(hashes))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        counts += _counted(np.array([digest(joined[i:j], seed) for i, j in pairs], np.uint64))
    return _majority(counts, len(starts))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        made = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], ["_row", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``_row``, ``doc_id`` and the fingerprint ``fp`` (as signed long) of each row; null texts count as empty."""
    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "_row")
    return rows.select("_row", "doc_id", "text").mapInArrow(_fingerprints, "_row long, doc_id long, fp long")


def ring(count: int = SEGMENTS) -> list[int]:
    """Bit masks of the segments, as even as 64 bits allow."""
    cuts = [i * 64 // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _halves(mask: int) -> list[int]:
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in part) for part in (bits[: len(bits) // 2], bits[len(bits) // 2 :])]


def key_masks(chain: int, radius: int = RADIUS, around: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask) of the exact keys for chains of so many segments; a linked pair shares at least one.

    Past the equal first segment, ``chain - 1`` of the halves are equal whatever way the allowed differences
    fall; the sets of halves needed to meet every such way are listed once for each start.
    """
    segments, shares = ring(around), [(n * radius) // around for n in range(1, chain + 1)]
    count = 2 * (chain - 1)
    equal = set()
    for diffs in product(range(shares[-1] + 1), repeat=count):
        totals = np.cumsum(np.reshape(diffs, (-1, 2)).sum(1))
        if all(t <= s for t, s in zip(totals, shares[1:], strict=True)):
            equal.add(frozenset(i for i, d in enumerate(diffs) if not d))
    least = min(map(len, equal))
    sets = [set(x) for x in combinations(range(count), least) if any(set(x) == e for e in equal)]
    assert all(any(s <= e for s in sets) for e in equal)
    out = []
    for start in range(around):
        halves = [h for n in range(1, chain) for h in _halves(segments[(start + n) % around])]
        out += [(start, segments[start] | sum(halves[i] for i in s)) for s in sets]
    return out


def _within(x: np.ndarray, start: np.ndarray | int, segments: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether the differing bits ``x`` keep every chain from ``start`` within its share of the radius."""
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
    for n in range(len(segments)):
        total = total + np.bitwise_count(x & segments[(start + n) % len(segments)])
        ok &= total <= (n + 1) * radius // len(segments)
        if not ok.any():
            break
    return ok


def _forest(values: np.ndarray, start: int, segments: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges of a spanning forest of one key's links: each value is compared with what no edge has reached."""
    left, a, b = values, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            hit = _within(left ^ v, start, segments, radius)
            if hit.any():
                got = left[hit]
                a += [np.full(len(got), v)]
                b += [got]
                queue += list(got)
                left = left[~hit]
    return a, b


def _linker(starts: list[int], radius: int, around: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, origin = np.array(ring(around), np.uint64), np.array(starts)

        def links(no, val, fp):
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            first = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (val[1:] != val[:-1])])
            length = np.diff(np.r_[first, len(no)])
            for n in (2, 3, 4):
                at = first[length == n]
                for i, j in combinations(range(n), 2):
                    x, y = fp[at + i], fp[at + j]
                    ok = _within(x ^ y, origin[no[at]], segments, radius)
                    a.append(x[ok]), b.append(y[ok])
            for at, n in zip(first[length > 4].tolist(), length[length > 4].tolist(), strict=True):
                own = fp[at : at + n]
                if n <= AT_ONCE and np.count_nonzero(np.bitwise_count(own[:, None] ^ own) <= radius) == n:
                    continue  # each is near itself only
                more = _forest(own, starts[no[at]], segments, radius)
                a += more[0]
                b += more[1]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        held: list[np.ndarray] = []
        for rows in batches:
            cols = [rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False), rows.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(cols[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last key may go on in the next batch
            if cut:
                yield links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield links(*held)

    return linked


def fingerprint_links(distinct: DataFrame, rows: int, radius: int = RADIUS, around: int = SEGMENTS, chain: int | None = None) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct fingerprints ``fp`` just as all links do.

    If their length isn't given, chains are taken long enough for the keys to be wider than the logarithm of
    the row count, so that unrelated fingerprints seldom share one; each length finds every link.
    """
    for length in [chain] if chain else [2, 3, 4]:
        masks = key_masks(length, radius, around)
        if rows <= 1 << min(m.bit_count() for _, m in masks) + length + 1:
            break
    signed = [m - (1 << 64) if m >> 63 else m for _, m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for i, m in enumerate(signed)]))
    dealt = distinct.select("fp", keys.alias("k")).select("k.no", "k.val", "fp").repartition("no", "val").sortWithinPartitions("no", "val")
    return dealt.mapInArrow(_linker([s for s, _ in masks], radius, around), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``_row``, ``doc_id``, ``fp`` and ``component_id`` (smallest doc_id reachable over links) of each row.

    Texts that are null or have no word share fingerprint zero and link like any other. Repeated rows are
    rows of the same component; null doc_ids never become a component's id unless it has no other. An
    empty table gives no row. Equal fingerprints are one node, so groups of copies cost one row each.
    """
    made = settle(fingerprints(docs))
    rows = made.count()
    nodes = settle(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), rows)
    count = nodes.count()
    roots = components(fingerprint_links(nodes.select("fp"), count), 10 * count)
    joined = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    named = joined.groupBy("root").agg(F.min("least").alias("least_of_all"))
    linked = joined.join(named, "root").select("fp", "least_of_all")
    named_nodes = settle(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least_of_all", "least").alias("component_id"), (F.col("n") * HOT >= rows).alias("hot")), count)
    hot = F.broadcast(named_nodes.where("hot").select("fp", F.col("component_id").alias("hot_id"), "hot"))
    parts = made.join(hot, "fp", "left")
    direct = parts.where("hot").select("_row", "doc_id", "fp", F.col("hot_id").alias("component_id"))
    others = parts.where("hot is null").select("_row", "doc_id", "fp").join(named_nodes.where("not hot").select("fp", "component_id"), "fp")
    return as_many_parts(direct.unionByName(others), docs)


def set_pairs(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of ``nodes`` (``node``, ``fp``) whose fingerprints are equal or within ``SET_RADIUS``.

    Of nodes with equal fingerprints one stands for all: the others are paired with it, and it with those of other fingerprints.
    """
    named = settle(nodes.groupBy("fp").agg(F.min("node").alias("center")), rows)
    same = nodes.select("node", "fp").join(named, "fp").where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"))
    a, b = (named.select(F.col("fp").alias(c), F.col("center").alias(f"center_{c}")) for c in "ab")
    count = named.count()
    links = fingerprint_links(named.select("fp"), count, SET_RADIUS, SET_SEGMENTS, 3 if count <= SET_NODES else 4)  # longer chains have 112 keys, which fill the disk
    return same.union(links.join(a, "a").join(b, "b").select("center_a", "center_b"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Keep one document of each near-duplicate group: that with the smallest doc_id (the first such row).

    Groups are of similar sets of five-word shingles. Fingerprints of the sets are linked by the pigeonring filter, and
    what they link is checked on the texts. Pairs that are similar but beyond the radius are no group yet: ``near_texts``
    finds them among what the fingerprints have left apart. Texts that are null or have no word are one group; of repeated
    rows one stays; an empty table stays empty; a document without doc_id stays only if its group has no other. Rows are
    written with an id once, so the result holds for any input, also one whose rows come in another order each time.
    """
    count = docs.count()
    held = settle(with_row_id(docs, ROW), count, PART_ROWS)
    texts = held.select(F.col(ROW).alias("_row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nodes = near_texts.shingle_sets(texts, set_fingerprint, count)
    links = near_texts.verified(nodes, texts, set_pairs(nodes, count), count)
    rows = near_texts.first_rows(nodes, texts, links, count).select(F.col("_row").alias(ROW))
    return held.join(rows, ROW, "left_semi").drop(ROW).coalesce(parts(count, PART_ROWS))
