"""The near-duplicate stage against all pairs."""

import random
from itertools import combinations

from strandweave.llm import near_texts, simhash


def plain_shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    """Smallest place of each component of texts that share 0.8 of their shingles, by comparing all."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def varied(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return words


def test_stage_groups_by_shingle_similarity(spark):
    rng = random.Random(3)
    some = lambda: [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(some()) for _ in range(30)]
    for _ in range(20):  # pairs on both sides of 0.8
        base = some()
        texts += [" ".join(base), " ".join(varied(rng, base, rng.randint(1, 8)))]
    hot, chain = some(), some()
    texts += [" ".join(varied(rng, hot, rng.randint(0, 4))) for _ in range(60)]  # many copies of a text, not all like each other
    for _ in range(40):  # a chain whose ends are not alike
        texts.append(" ".join(chain))
        chain = varied(rng, chain, 2)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == plain_kept(texts)


def test_band_keys_meet_at_the_threshold():
    rng = random.Random(4)
    for _ in range(200):
        both, one, two = ([rng.getrandbits(64) for _ in range(n)] for n in (160, 20, 20))
        sets = [near_texts.np.unique(near_texts.np.array(both + x, "uint64")) for x in (one, two)]
        assert near_texts.similarity(*sets) == 0.8 and {*near_texts.band_keys(sets[0])} & {*near_texts.band_keys(sets[1])}


def test_bitmaps_never_part_similar_sets():
    rng, np = random.Random(5), near_texts.np
    for n in (5, 63, 64, 200, 5000):
        both = [rng.getrandbits(64) for _ in range(n)]
        one, two = (np.unique(np.array(both + [rng.getrandbits(64) for _ in range(k)], "uint64")) for k in (n // 9, n // 7))
        x, y = (near_texts.parity(s).view(np.uint64)[None] for s in (one, two))
        words = min(x.shape[1], y.shape[1])
        apart = np.bitwise_count(near_texts._folded(x, words) ^ near_texts._folded(y, words)).sum()
        assert apart <= len(one) + len(two) - 2 * n


def test_stage_links_fingerprints_and_then_the_texts(spark, monkeypatch):
    """The stage goes through the fingerprints' links; what they link is true, and all of it that is true is connected."""
    rng, calls, links = random.Random(6), [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *given: calls.append(given[2:]) or links(*given))
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(varied(rng, base, rng.randint(0, 6)))]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, doc_id long, text string").repartition(3)
    nodes = near_texts.shingle_sets(docs, simhash.set_fingerprint)
    found = {(r.a, r.b) for r in near_texts.verified(nodes, docs, simhash.set_pairs(nodes)).collect()}
    fp, sets = {r.node: r.fp for r in nodes.collect()}, [plain_shingles(t) for t in texts]
    apart = {(i, j): bin((fp[i] ^ fp[j]) % (1 << 64)).count("1") for i, j in combinations(sorted(fp), 2)}
    alike = {(i, j) for i, j in apart if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert found == {p for p in alike if apart[p] <= simhash.SET_RADIUS} and len(found) > 20 and found < alike
    assert {r.doc_id for r in simhash.first_of_each(docs.drop("_row")).collect()} == plain_kept(texts)
    assert calls == [(simhash.SET_RADIUS, simhash.SET_SEGMENTS, 3)] * 2


def test_wider_keys_miss_no_link():
    rng, radius, around = random.Random(7), simhash.SET_RADIUS, simhash.SET_SEGMENTS
    for chain in (2, 3, 4):
        masks = simhash.key_masks(chain, radius, around)
        for _ in range(2000):
            apart = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not apart & m for _, m in masks)


def test_small_tables_are_settled_to_few_files(spark, monkeypatch):
    """Each file of an executor costs it processes, so their number follows the rows, not the shuffle partitions or the input's."""
    rng, kind, files = random.Random(8), type(spark.range(0)), []

    def counted(self, *given, plain=kind.checkpoint, **more):
        out = plain(self, *given, **more)
        files.append(out.rdd.getNumPartitions())
        return out

    texts = []
    for _ in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(base), " ".join(varied(rng, base, rng.randint(0, 3)))]
    hot = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(varied(rng, hot, rng.randint(0, 4))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(23)
    set_to = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    monkeypatch.setattr(kind, "checkpoint", counted)
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        out = simhash.first_of_each(docs)
        assert {r.doc_id for r in out.collect()} == plain_kept(texts)
        assert out.rdd.getNumPartitions() <= 6 and len(files) > 10 and max(files) <= 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
