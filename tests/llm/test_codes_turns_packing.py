"""Vector codes, conversation repair and packing against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandweave.llm import code_compression, packing, turn_repair

VECTORS = "vec_id long, embedding array<float>, label int, code string, vec string, dim int"


def plain_codes(rows):
    """vec_id, code, error and label of each usable row, and the digest of each length's codebooks; integers only."""
    kept = [(i, [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows if v is not None]
    kept = [(i, v, label) for i, v, label in kept if all(c is not None and np.isfinite(c) for c in v)]
    out, hashes = [], {}
    for dim in {len(v) for _, v, _ in kept}:
        w = -(-dim // 4)
        whole = lambda v: [int(np.floor(1024 * c)) for c in v] + [0] * (4 * w - dim)  # noqa: E731, B023
        own = [(i, [whole(v)[p * w : (p + 1) * w] for p in range(4)], label) for i, v, label in kept if len(v) == dim]  # noqa: B023
        ids = {i: parts for i, parts, _ in own if i is not None}
        books = [[ids[i][p] for i in sorted(ids)[:256]] for p in range(4)]
        near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), n) for n, e in enumerate(b))
        for _ in range(4):
            for p in range(4):
                of = {}
                for _, parts, _ in own:
                    of.setdefault(near(parts[p], books[p])[1], []).append(parts[p])
                books[p] = [[sum(c) // len(of[n]) for c in zip(*of[n], strict=True)] if n in of else e for n, e in enumerate(books[p])]
        hashes[dim] = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, parts, label in own:
            found = [near(x, b) for x, b in zip(parts, books, strict=True)]
            out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label, hashes[dim]))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, code, error, total[label], h) for i, code, error, label, h in out), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 3, 8).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(300)]  # many ties
    rows += [(300 + i, (rng.standard_normal(8) / 3).astype(np.float32).tolist(), 3) for i in range(100)]
    rows += [(500 + i, [0.5] * 8, 4) for i in range(200)]  # one hot vector
    rows += [(None, [0.25] * 8, None), (700, None, 1), (701, [None] + [1.0] * 7, 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] * 8, 1), (3, rows[3][1], 2)]
    return rows + [(800, [1.0, 2.0, 3.0, 4.0, 5.0], 5), (801, [1.0, 2.0, 3.0, 4.0, 6.0], 5), (900, [], 6)]


def test_codes_equal_whole_number_search(spark, vectors):
    df = spark.createDataFrame([(i, v, label, "a", "b", 1) for i, v, label in vectors], VECTORS)
    assert sorted((tuple(r) for r in code_compression.compress(df.repartition(5)).collect()), key=str) == plain_codes(vectors)


def test_codes_of_one_copy_and_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.5, 0.5], 0, "", "", 0)] * 3, VECTORS)
    assert [(r.code, r.error, r.label_error) for r in code_compression.compress(df).collect()] == [("00000000", 0, 0)] * 3
    assert code_compression.compress(df.where("false")).collect() == []


def test_codes_of_large_numbers(spark):
    rows = [(i, [1e12 * (i % 3), -3e15, 5.0, 1e30], 0, "", "", 0) for i in range(6)]
    assert sorted(r.code for r in code_compression.compress(spark.createDataFrame(rows, VECTORS)).collect()) == sorted(f"0{i % 3}000000" for i in range(6))


@given(st.integers(0, 1 << 62), st.integers(1, 40), st.sampled_from([3, 1000, 1 << 24, 1 << 33, 1 << 60]))
@settings(max_examples=60, deadline=None)
def test_intervals_hold_the_true_value(seed, n, size):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size, (7, n)), rng.integers(-size, size, (9, n))
    low, high = code_compression.interval(x, c)
    for i, a in enumerate(x.tolist()):
        for j, b in enumerate(c.tolist()):
            assert low[i, j] <= sum(t * t for t in b) - 2 * sum(s * t for s, t in zip(a, b, strict=True)) <= high[i, j]
    index, distance = code_compression.nearest(x, c)
    want = [min((sum((s - t) ** 2 for s, t in zip(a, b, strict=True)), j) for j, b in enumerate(c.tolist())) for a in x.tolist()]
    assert [(int(d), int(j)) for d, j in zip(distance, index, strict=True)] == want


def test_intervals_leave_few_entries_of_common_vectors():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-1024, 1024, (500, 16)), rng.integers(-1024, 1024, (256, 16))
    low, high = code_compression.interval(x, c)
    assert (low <= high.min(1)[:, None]).sum() < 1.1 * len(x)


def test_codes_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    got = code_compression.compress(spark.read.parquet(f"{data}/embeddings.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(code_compression.ORACLE).fetchall())


def plain_repair(rows):
    """Each conversation edited turn by turn in every way, the best of each last role kept."""
    convs = {}
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        own += [] if code == 0 else [(t, "user" if code == 4 else r, x)] * (1 + (code == 3))
    out, after, name = [], {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    for c, own in convs.items():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
        turns, seen, faults = [t for t, _, _ in own if t is not None], set(), []
        for _, r, x in own:
            ends = x.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("b" if not ends else "d" if (r, x) in seen else "" if ends in ".!?" else "t")
            seen.add((r, x))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        best = [{} for _ in range(len(own) + 1)]
        best[0][""] = (0, "", ())

        def put(at, state, cost, audit, made, best=best):
            if state not in best[at] or (cost, audit) < best[at][state][:2]:
                best[at][state] = (cost, audit, made)
                return True

        for at in range(len(own) + 1):
            while any([put(at, after[s], c0 + 3, a0 + "I", (*m0, name[after[s]] + ":")) for s, (c0, a0, m0) in list(best[at].items())]):
                pass
            for s, (c0, a0, m0) in best[at].items() if at < len(own) else ():
                _, r, x = own[at]
                put(at + 1, s, c0 + 4, a0 + "D", m0)
                if faults[at] not in ("b", "d"):
                    more = 3 if faults[at] == "t" else 0
                    if r[:1] == after[s] or (r[:1], s) == ("s", ""):
                        put(at + 1, r[:1], c0 + more, a0 + "K", (*m0, f"{r}:{x}"))
                    put(at + 1, after[s], c0 + 3 + more, a0 + "R", (*m0, f"{name[after[s]]}:{x}"))
        cost, audit, made = min((best[-1][s] for s in ("", "a") if s in best[-1]), key=lambda v: v[:2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", "User", None, "user", "assistant"], ["Hi.", "no", "", "  \n", "a. b", "Ok!\t", "x", None, "é?", ".", "q.", "r.", "s."]
    rows = [(c or None, rng.choice([t, t, t, None, rng.randint(0, 9)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.choice([1, 2, 3, 5, 8, 12, 20]))]
    rows += [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"no {t}", f"t{t}."])) for t in range(600)]  # a hot conversation
    rows += [(1001, None, "user", "Same.")] * 150 + [(1002, 7, "assistant", f"{n}.") for n in range(150)]  # all of one turn
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string, at int, cost string"


@pytest.mark.parametrize("parts", [None, 40])
def test_repair_equals_brute_force(spark, talks, parts):
    df = spark.createDataFrame([(*r, 1, "x") for r in talks], TALK)
    assert sorted((tuple(r) for r in turn_repair.repaired(df, parts).collect()), key=str) == plain_repair(talks)


def test_repair_sql_equals_brute_force(talks):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(talks, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(turn_repair.ORACLE).fetchall(), key=str) == plain_repair(talks)


def test_repair_of_nothing_left(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "Hi.", 0, "")]
    assert [tuple(r) for r in turn_repair.repaired(spark.createDataFrame(rows, TALK)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.repaired(spark.createDataFrame([], TALK)).collect() == []


def test_repair_of_a_very_long_text(spark):
    rows = [(2, 1, "user", "a" + " " * 300_000 + ".", 0, ""), (2, 3, "assistant", " " * 300_000, 0, "")]
    assert [tuple(r) for r in turn_repair.repaired(spark.createDataFrame(rows, TALK)).collect()] == plain_repair([r[:4] for r in rows])


WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_word_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(1)
    letters = [*"abcAB'sS .,\n\t\r\x0b\x1c\x85\xa0éΣσςİIıßﬁé1２中日本한가\U0001f600<|>", "<|endoftext|>", "<|startoftext|>", " ", "'re", "̀"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "x" * 5000, "word " * 5000]
    texts += [f"{chr(c)} {chr(c)}a{chr(c)}" for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000]
    texts += [f"{chr(c)} a{chr(c)}b1{chr(c)}{chr(c)}' {chr(c)}'s'{chr(c)}" for c in range(0x300)] + ["".join(map(chr, rng.choices(range(0x260), k=30))) for _ in range(3000)]
    want = [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]
    for most in (packing.WORDS, 100):
        monkeypatch.setattr(packing, "WORDS", most)
        words = packing.Words(WORDS)
        assert [i.tolist() for n in range(0, len(texts), 500) for i in words.ids(texts[n : n + 500])] == want


def test_words_are_looked_up_once_a_batch(library):
    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    words, texts = packing.Words(WORDS), ["left out", *["one two\tthree  " * 500] * 8, "", " ", "four"]
    words.words = Counted()
    want = [e.ids + [1] for e in library.encode_batch(texts[1:], add_special_tokens=False)]
    assert [i.tolist() for i in words.ids(pa.array(texts)[1:])] == want and Counted.seen == 5


def best_sum(items, room):
    reach = {0}
    for i in items:
        reach |= {r + i for r in reach if r + i <= room}
    return max(reach)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_fullest_combination(counts, room):
    found = packing.fullest(sorted(counts), counts, room)
    assert all(n <= counts[k] for k, n in found)
    assert sum(k * n for k, n in found) == best_sum([k for k, n in counts.items() for _ in range(n)], room)


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(lengths):
    counts = {k: lengths.count(k) for k in lengths}
    plan = packing.plan(counts, 64)
    assert all(sum(k * n for k, n in filling) <= 64 for _, filling in plan)
    placed = {}
    for times, filling in plan:
        for k, n in filling:
            placed[k] = placed.get(k, 0) + times * n
    assert placed == counts
    places, seen = packing.Places(plan), {}
    for k, n in counts.items():
        for s, o in zip(*(x.tolist() for x in places.find(np.full(n, k), np.arange(n))), strict=True):
            seen.setdefault(s, []).append((o, k))
    assert sorted(seen) == list(range(sum(t for t, _ in plan)))
    for own in seen.values():
        ends = np.cumsum([k for _, k in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()]


def check_packing(got, docs, library, room):
    """Pieces against the library, sequences gapless and within room; returns how many there are."""
    made = {}
    for r in got:
        made.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    want = {}
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(doc, []).extend((n, at, len(ids[at : at + room]), zlib.crc32(ids[at : at + room].tobytes())) for n, at in enumerate(range(0, len(ids), room)))
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in want.items()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= room
    return len(by)


@pytest.mark.parametrize("share", [7, packing.SHARE])
def test_packing_of_nulls_copies_and_long_texts(spark, library, share):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choices(["the", "quick", "brown", "fox"], k=rng.randint(0, 90)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "one " * 1000), (303, "a" * 2000), (None, "no id"), (5, docs[5][1])] + [(400 + i, "same text here") for i in range(100)]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, piece string, length int").repartition(6)
    got = packing.pack(df, WORDS, 64, share).collect()
    assert check_packing(got, docs, library, 64) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(df.where("false"), WORDS).collect() == []


def test_packing_of_the_table_is_close_to_full(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = packing.pack(docs, WORDS).collect()
    assert check_packing(got, docs.select("doc_id", "text").collect(), library, 4096) <= -(-sum(r.length for r in got) // 4096) + 1
