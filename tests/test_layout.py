"""The spanning layout of a dot plot."""

import random

import pytest

from strandweave.operators import dotplot

MAPPINGS = "q_name string, q_len long, q_start long, q_end long, strand string, ref_name string, ref_len long, ref_start long, ref_end long, identity double"


def plain_span(rows):
    """Names with direction along both axes, by recursion over one best mapping a pair."""
    best = {}
    for q, ql, qs, qe, strand, r, rl, rs, re, _ in rows:
        key = (re - rs, -rs, -qs)
        if (q, r) not in best or key > best[q, r][0]:
            best[q, r] = (key, {"r": [rs, re], "q": [qs, qe], "slope": -1 if strand == "-" else 1})
    size = {("r", r): rl for _, _, _, _, _, r, rl, *_ in rows} | {("q", q): ql for q, ql, *_ in rows}
    link = lambda x, y: best[(y[1], x[1]) if x[0] == "r" else (x[1], y[1])][1]
    near = {x: [y for y in size if y[0] != x[0] and ((y[1], x[1]) if x[0] == "r" else (x[1], y[1])) in best] for x in size}
    done, axes = set(), {"r": [], "q": []}

    def visit(x):
        later = []
        for y in sorted(near[x], key=lambda y: (link(x, y)[x[0]][0], y[1])):
            if y in done:
                continue
            done.add(y)
            turn = link(x, y)["slope"]
            if turn < 0:
                for z in near[y]:
                    held = link(y, z)
                    held["slope"] *= -1
                    lo, hi = held[y[0]]
                    held[y[0]] = [size[y] - hi, size[y] - lo]
            axes[y[0]].append((y[1], turn))
            if size[y] > size[x]:
                visit(y)
            else:
                later.append(y)
        for y in later:
            visit(y)

    for x in sorted((x for x in size if x[0] == "r"), key=lambda x: (-size[x], x[1])):
        visit(x)
    return axes


def shown(frame):
    rows = frame.orderBy("offset").collect()
    total = 0
    for r in rows:
        assert r.offset == total
        total += r.len - 1
    return [(r.name, r.direction) for r in rows]


def test_three_sequences_that_span_each_other(spark):
    rows = [("q1", 500, 0, 200, "+", "r1", 1000, 700, 900, 0.9), ("q2", 3000, 0, 300, "-", "r1", 1000, 100, 400, 0.9), ("q2", 3000, 1000, 1400, "-", "r2", 400, 0, 400, 0.9), ("q3", 90, 0, 90, "+", "r2", 400, 300, 390, 0.9)]
    targets, queries = dotplot.layout(spark.createDataFrame(rows, MAPPINGS), fattest=False)
    # From r1, q2 lies first, backwards, and is longer: it is turned round and places r2, by where its turned place is, and r1.
    assert shown(queries) == [("q2", -1), ("q3", 1), ("q1", 1)] and shown(targets) == [("r2", 1), ("r1", 1)]
    assert [shown(x) for x in dotplot.layout(spark.createDataFrame(rows, MAPPINGS))] != [shown(targets), shown(queries)]
    assert [x.count() for x in dotplot.layout(spark.createDataFrame([], MAPPINGS), fattest=False)] == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_spanning_layout_by_recursion(spark, seed):
    rng = random.Random(seed)
    lens = {n: 1000 + 7 * i for i, n in enumerate(rng.sample([f"{s}{i}" for s in "rq" for i in range(12)], 24))}
    rows = []
    for _ in range(22):
        q, r = f"q{rng.randrange(12)}", f"r{rng.randrange(12)}"
        size = rng.randint(10, 500)
        qs, rs = rng.randint(0, 400), rng.randint(0, 400)
        rows.append((q, lens[q], qs, qs + size, rng.choice("+-"), r, lens[r], rs, rs + size, 0.9))
    want = plain_span(rows)
    targets, queries = dotplot.layout(spark.createDataFrame(rows, MAPPINGS), fattest=False)
    blocks = lambda names: {n for n, _ in names}
    assert blocks(shown(targets)) == blocks(want["r"]) and shown(targets) == want["r"] and shown(queries) == want["q"]
    drawn = dotplot.plot_rows(spark.createDataFrame(rows, MAPPINGS), targets, queries)
    assert drawn.count() == len(rows)
