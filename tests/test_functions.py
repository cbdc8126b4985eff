import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import kmers as K
from strandweave.functions import stats as S
from strandweave.operators import align as A
from strandweave.params import MapParams, number


@pytest.mark.parametrize("text, value", [("ACGTACGTACGTACGTACG", 2819345507021956028), ("A" * 19, 15847913859181992338), ("ACGT" * 4, 4706917051267373191)])
def test_murmur_vectors(text, value):
    assert int(K.murmur3_low64(np.frombuffer(text.encode(), np.uint8)[None])[0]) == value


def test_murmur_public_vector():
    assert int(K.murmur3_low64(np.frombuffer(b"hello", np.uint8)[None], 0)[0]) == 0xCBD8A7B341BD9B02


def test_hash_columns_keep_unsigned_order(spark):
    df = spark.createDataFrame([("ACGTACGTACGTACGTACG",), ("A" * 19,), ("ACGT" * 4,)], "k string")
    by = [r.k for r in df.orderBy(K.kmer_hash(F.col("k"), "murmur3")).collect()]
    assert by == ["ACGTACGTACGTACGTACG", "ACGT" * 4, "A" * 19]
    assert spark.createDataFrame([("abc",)], "k string").select(K.kmer_hash(F.col("k"), "md5_60")).first()[0] == 648541476951500027


def test_sequence_functions(spark):
    df = spark.createDataFrame([("acgtnXß",)], "s string")
    assert df.select(K.normalise(F.col("s")), K.reverse_complement(F.lit("ACGTN"))).first()[:] == ("ACGTNNN", "NACGT")
    assert df.select(K.name_prefix(F.lit("A#1#c"), "#"), K.name_prefix(F.lit("abc"), "#"), K.project_dna(F.lit("Abc, z"))).first()[:] == ("A#1", "abc", "ACGC"[:3] + K.PROJECTION[25])


def test_fragments(spark):
    rows = [(1, "x" * 450), (2, "x" * 400), (3, "x" * 100), (4, "xy"), (5, "ab\n" * 100)]
    f = K.fragments(spark.createDataFrame(rows, "seq_id long, seq string"), 200, 12)
    got = {}
    for r in f.orderBy("seq_id", "frag_no").collect():
        got.setdefault(r.seq_id, []).append((r.frag_start, len(r.frag)))
    assert got == {1: [(0, 200), (200, 200), (250, 200)], 2: [(0, 200), (200, 200)], 3: [(0, 100)], 5: [(0, 200), (100, 200)]}
    assert K.fragments(spark.createDataFrame(rows, "seq_id long, seq string"), 200, 12, split=False).count() == 4


def test_kmers_drop_palindromes_and_n(spark):
    f = spark.createDataFrame([(1, 0, 10, "ACGTNACCT")], "seq_id long, frag_no int, frag_start long, frag string")
    assert sorted(r.pos for r in K.kmers(f, 4).collect()) == [15]  # ACGT is its own reverse complement
    strands = {r.strand for r in K.kmers(spark.createDataFrame([(1, 0, 0, "AAAACCCC")], "seq_id long, frag_no int, frag_start long, frag string"), 3).collect()}
    assert strands <= {1, -1}


def test_sql_functions(spark):
    K.register(spark)
    assert spark.sql("select revcomp('AACG') as r, normalise_dna('acx') as n").first()[:] == ("CGTT", "ACN")
    assert [tuple(r) for r in spark.sql("select * from kmers('ABCD', 3)").collect()] == [(0, "ABC"), (1, "BCD")]


@given(st.floats(0.0, 0.5), st.integers(5, 31))
def test_distance_and_jaccard_are_inverse(d, k):
    assert S.j2md(S.md2j(d, k), k) == pytest.approx(d, abs=1e-9)


def test_statistics():
    assert S.j2md(0, 19) == 1 and S.j2md(1, 19) == 0
    assert S.minimum_hits(130, 19, 0.85) == 4 and S.minimum_hits_relaxed(130, 19, 0.85, 0.95) <= 4
    assert S.md_lower_bound(0.15, 130, 19, 0.95) < 0.15 < S.md_lower_bound(0.3, 130, 19, 0.95) + 0.2
    sizes = [S.recommended_sketch_size(1e-3, 19, 4, 0.85, 5000, n) for n in (10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and all(n % 10 == 0 for n in sizes)
    cut = S.hypergeometric_cutoffs(100, 19, 0.0, 0.999)
    assert cut[100] == 100 and all(a <= b for a, b in zip(cut, cut[1:], strict=False)) and all(c <= max(1, n) for n, c in enumerate(cut))
    assert all(a <= b for a, b in zip(S.hypergeometric_cutoffs(100, 19, 0.05, 0.999), cut, strict=True))
    tails = S._binomial_tails(20, 0.3)
    assert tails[0] == pytest.approx(1) and tails[20] == pytest.approx(0.3**20) and tails[21] == 0


def test_parameters():
    assert MapParams().block == 5000 and MapParams(filter_mode="none").use_hg is False and number("1.5k") == 1500
    for bad in ({"identity": 0.4}, {"segment_length": 50}, {"filter_mode": "x"}, {"kmer": 6000}, {"sparsify": 0}, {"algorithm": "x"}):
        with pytest.raises(ValueError):
            MapParams(**bad)
    assert MapParams(dense=True).size(10**6) == int(0.02 * 4 * 4981) and MapParams(sketch_size=7).size(1) == 7


def table_distance(q, t, mode):
    m, n = len(q), len(t)
    d = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            d[i][j] = (0 if mode == "infix" else j) if not i else i if not j else min(d[i - 1][j - 1] + (q[i - 1] != t[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[m][n] if mode == "global" else min(d[m])


@settings(max_examples=300, deadline=None)
@given(st.text("ACG", max_size=14), st.text("ACG", max_size=16), st.sampled_from(["global", "prefix", "infix"]))
def test_alignment_is_optimal(q, t, mode):
    distance, length, cigar = A.align_pair(q, t, None, mode)
    parts = re.findall(r"(\d+)([=XID])", cigar)
    assert distance == table_distance(q, t, mode) == sum(int(n) for n, c in parts if c != "=")
    assert sum(int(n) for n, c in parts if c in "=XI") == len(q) and sum(int(n) for n, _ in parts) == length


def test_alignment_limit_and_forms():
    assert A.align_pair("ACGT", "TTTT", 1) is None and A.cigar("==XI=", extended=False) == "3M1I1M"
    rng = random.Random(1)
    q = "".join(rng.choice("ACGT") for _ in range(3000))
    assert A.align_pair(q, "GG" + q + "TT")[0] == 0


@pytest.mark.parametrize("algorithm", ["xxhash64", "md5_60", "murmur3"])
@pytest.mark.parametrize("alphabet", ["dna", "text"])
def test_sketches_within_rows_are_those_of_all_kmers(spark, algorithm, alphabet):
    from strandweave.operators import sketch

    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(rng.randint(0, 700))) for i in range(25)] + ["ACGT" * 40, "", "é漢字ß" * 30 if alphabet == "text" else "NNNNNNNNNNNN"]
    frags = K.fragments(spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string"), 300, 11)
    columns = ["seq_id", "frag_no", "hash", "pos", "strand", "rank"]
    want = sketch.bottom_sketch(K.kmers(frags, 11, algorithm, alphabet), 20).select(columns).collect()
    assert sorted(map(tuple, sketch.fragment_sketches(frags, 11, 20, algorithm, alphabet).select(columns).collect())) == sorted(map(tuple, want))


def full_table(query, target):
    """The operations by the whole table of distances, insertion before deletion before a pair."""
    m, n = len(query), len(target)
    d = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (query[i - 1] != target[j - 1]))
    out = []
    while m or n:
        if m and d[m][n] == d[m - 1][n] + 1:
            out, m = [*out, "I"], m - 1
        elif n and d[m][n] == d[m][n - 1] + 1:
            out, n = [*out, "D"], n - 1
        else:
            out, m, n = [*out, "=" if query[m - 1] == target[n - 1] else "X"], m - 1, n - 1
    return "".join(reversed(out))


@given(st.text("ACG", max_size=30), st.text("ACG", max_size=30))
def test_operations_in_a_band_are_those_of_the_whole_table(q, t):
    want = full_table(q, t)
    assert A.operations(q, t) == want == A.operations(q, t, sum(c != "=" for c in want))


def test_operations_of_long_texts():
    """Over many kept rows; a whole table would take 400 MB."""
    rng = random.Random(2)
    q = "".join(rng.choice("ACGT") for _ in range(20_000))
    t = "".join(c if rng.random() > 0.02 else rng.choice(["", "A", "CG"]) for c in q)
    distance = A.distance_ends(q, t, "global")[0]
    ops = A.operations(q, t, distance)
    assert sum(c != "=" for c in ops) == distance
    assert sum(c != "D" for c in ops) == len(q) and sum(c != "I" for c in ops) == len(t)


def test_cut_out_across_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(A.CHUNK * 2 + 100))
    seqs = spark.createDataFrame([("a", text), ("b", "")], "name string, seq string")
    spans = [(0, "a", 3, 9), (1, "a", A.CHUNK - 2, 2 * A.CHUNK + 5), (2, "a", A.CHUNK, A.CHUNK + 1)]
    got = {r._row: r.out for r in A.cut_out(spark.createDataFrame(spans, "_row long, name string, start long, end long"), seqs, "out").collect()}
    assert got == {i: text[a:b] for i, _, a, b in spans}


def test_hashes_of_joined_texts(monkeypatch):
    import xxhash

    monkeypatch.setattr(K, "HASHED", 40)
    rng = random.Random(0)
    texts = ["".join(rng.choices("ACGTNé中", k=rng.choice([0, 3, 11, 70]))) for _ in range(40)]
    for k in (1, 5, 33):
        for text, (hashes, strands, good) in zip(texts, K.hashed_each(texts, k, alphabet="text"), strict=True):
            assert hashes.view("u8").tolist() == [xxhash.xxh64_intdigest(text[i : i + k].encode(), 42) for i in range(len(text) - k + 1)]
        for text, made in zip(texts, K.hashed_each(texts, k), strict=True):
            alone = K.hashed(text, k)
            assert all((x[alone[2]] == y[alone[2]]).all() for x, y in zip(made[:2], alone[:2], strict=True)) and (made[2] == alone[2]).all()
