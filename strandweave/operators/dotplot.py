"""Layout of sequences along the axes of a dot plot, and its segments.

Mappings have q_name, q_len, q_start, q_end, strand ('+' or '-'), ref_name, ref_len, ref_start, ref_end and identity.
By default each query is placed by its fattest mapping, that with the longest stretch of the target (then the largest
target name and starts). A query has one such mapping, so placing is ordering: targets from long to short, and
queries by their target and the place on it; no walk over the graph of mappings is needed. The other layout
walks that graph, a component at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.graph import components
from strandweave.operators.ordered import running_total
from strandweave.session import settle


def sequence_lengths(mappings: DataFrame, side: str) -> DataFrame:
    """``name`` and ``len`` of each sequence of a side (``q`` or ``ref``)."""
    return mappings.groupBy(F.col(f"{side}_name").alias("name")).agg(F.max(f"{side}_len").alias("len"))


#: Sides of the graph of mappings.
REF, QUERY = 0, 1


def span(links: pd.DataFrame) -> pd.DataFrame:
    """Order and direction of the sequences of a component of the graph, from its ``links``, one for each pair that maps.

    Links have the names, lengths, starts and ends on both sides, and ``slope`` (-1: backwards). From a sequence its unplaced
    partners follow on the other side by where they lie on it; one that lies backwards is turned round, and all of its links
    with it. A partner longer than the sequence is gone on from at once, shorter ones after all partners are placed. Walks
    start at targets from long to short.
    """
    size: dict[tuple, int] = {}
    at: dict[tuple, dict[tuple, list[int]]] = {}
    slope: dict[frozenset, int] = {}
    for r in links.itertuples(index=False):
        a, b = (REF, r.ref_name), (QUERY, r.q_name)
        size[a], size[b] = int(r.ref_len), int(r.q_len)
        at.setdefault(a, {})[b] = [int(r.ref_start), int(r.ref_end)]
        at.setdefault(b, {})[a] = [int(r.q_start), int(r.q_end)]
        slope[frozenset((a, b))] = int(r.slope)
    placed: dict[tuple, int] = {}

    def place(one: tuple, by: tuple) -> None:
        placed[one] = turn = slope[frozenset((one, by))]
        if turn < 0:
            for other, ends in at[one].items():
                slope[frozenset((one, other))] *= -1
                ends[:] = size[one] - ends[1], size[one] - ends[0]

    def partners(one: tuple):
        """Places partners one by one; yields those to go on from, in order."""
        later = []
        for other in sorted(at[one], key=lambda x: (at[one][x][0], x)):
            if other not in placed:
                place(other, one)
                if size[other] > size[one]:
                    yield other
                else:
                    later.append(other)
        yield from later

    for start in sorted((n for n in size if n[0] == REF), key=lambda n: (-size[n], n)):
        stack = [partners(start)]
        while stack:
            following = next(stack[-1], None)
            stack.append(partners(following)) if following else stack.pop()
    first = min((-size[n], n[1]) for n in size if n[0] == REF)
    rows = [(side, name, size[side, name], turn, *first, n) for n, ((side, name), turn) in enumerate(placed.items())]
    return pd.DataFrame(rows, columns=["side", "name", "len", "direction", "_size", "_first", "_n"])


def _spanning(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    fat = F.struct((F.col("ref_end") - F.col("ref_start")).alias("n"), (-F.col("ref_start")).alias("r"), (-F.col("q_start")).alias("q"))
    kept = [F.max_by(F.struct("ref_start", "ref_end", "q_start", "q_end", F.when(F.col("strand") == "-", -1).otherwise(1).alias("slope")), fat).alias("at"), F.max("q_len").alias("q_len"), F.max("ref_len").alias("ref_len")]
    links = mappings.groupBy("q_name", "ref_name").agg(*kept).select("q_name", "ref_name", "q_len", "ref_len", "at.*")
    # Equal hashes only put two components together, which are still walked one by one.
    links = settle(links.withColumns({"a": F.xxhash64(F.lit(REF), "ref_name"), "b": F.xxhash64(F.lit(QUERY), "q_name")}))
    roots = components(links.select("a", "b"))
    found = settle(links.join(roots, F.col("a") == F.col("node")).drop("a", "b", "node").groupBy("root").applyInPandas(span, "side int, name string, len long, direction int, _size long, _first string, _n long"))
    side = lambda which: running_total(found.where(F.col("side") == which), ["_size", "_first", "_n"], F.col("len") - 1, "offset").select("name", "len", "offset", "direction")
    return side(REF), side(QUERY)


def layout(mappings: DataFrame, fattest: bool = True) -> tuple[DataFrame, DataFrame]:
    """``name``, ``len``, ``offset`` and ``direction`` (-1: drawn backwards) of targets and of queries.

    Targets that hold no query's fattest mapping come last, by name. Without mappings both are empty. If not by the ``fattest``,
    all pairs that map span each other (see ``span``): sequences that a chain of mappings connects are one task's.
    """
    if not fattest:
        return _spanning(mappings)
    longest = F.struct(F.col("ref_end") - F.col("ref_start"), "ref_name", "ref_start", "q_start", "strand")
    fat = mappings.groupBy(F.col("q_name").alias("name")).agg(F.max("q_len").alias("len"), F.max_by(F.struct("ref_name", "ref_len", "ref_start", "strand"), longest).alias("at"))
    used = fat.select(F.col("at.ref_name").alias("name"), F.lit(True).alias("used")).distinct()
    targets = sequence_lengths(mappings, "ref").join(used, "name", "left").withColumn("_last", F.col("used").isNull())
    targets = targets.select("name", "len", "_last", F.when(F.col("_last"), 0).otherwise(-F.col("len")).alias("_size"), F.lit(1).alias("direction"))
    queries = fat.select("name", "len", (-F.col("at.ref_len")).alias("_size"), F.col("at.ref_name").alias("_ref"), F.col("at.ref_start").alias("_at"), F.when(F.col("at.strand") == "-", -1).otherwise(1).alias("direction"))
    columns = ["name", "len", "offset", "direction"]
    step = F.col("len") - 1
    return (
        running_total(targets, ["_last", "_size", "name"], step, "offset").select(*columns),
        running_total(queries, ["_size", "_ref", "_at", "name"], step, "offset").select(*columns),
    )


def plot_rows(mappings: DataFrame, targets: DataFrame, queries: DataFrame, break_length: int | None = None) -> DataFrame:
    """A segment (x1, y1)-(x2, y2) with identity for each mapping of laid out sequences, ``forward`` or not.

    Ends are the last places, and a mapping on the minus strand runs down the query. Sequences drawn backwards are
    mirrored, then offsets are added. With ``break_length``, ``broken`` marks those that begin or end farther than
    that from all ends of both sequences.
    """
    on = lambda df, side: df.select(F.col("name").alias(f"{side}_name"), F.col("len").alias(f"_{side}_len"), F.col("offset").alias(f"_{side}_off"), F.col("direction").alias(f"_{side}_dir"))
    rows = mappings.join(on(targets, "ref"), "ref_name").join(on(queries, "q"), "q_name")
    minus, last = F.col("strand") == "-", F.col("q_end") - 1
    ends = {
        "x1": ("ref", F.col("ref_start")),
        "x2": ("ref", F.col("ref_end") - 1),
        "y1": ("q", F.when(minus, last).otherwise(F.col("q_start"))),
        "y2": ("q", F.when(minus, F.col("q_start")).otherwise(last)),
    }
    rows = rows.withColumns({c: F.when(F.col(f"_{s}_dir") == -1, F.col(f"_{s}_len") - at + 1).otherwise(at) for c, (s, at) in ends.items()})
    rows = rows.withColumn("forward", (F.col("x1") < F.col("x2")) == (F.col("y1") < F.col("y2")))
    if break_length is not None:
        far = lambda x, y: (F.least(x, y) - 1 > break_length) & (F.col("_ref_len") - F.col(x) > break_length) & (F.col("_q_len") - F.col(y) > break_length)
        rows = rows.withColumn("broken", far("x1", "y1") | far("x2", "y2"))
    rows = rows.withColumns({c: F.col(c) + F.col(f"_{s}_off") for c, (s, _) in ends.items()})
    return rows.select(*mappings.columns, "x1", "y1", "x2", "y2", "forward", *(["broken"] if break_length is not None else []))


def plot_lines(rows: DataFrame, coverage: bool = False) -> DataFrame:
    """Plot data as text, from low to high identity: two points of a segment, then two empty lines.

    ``coverage`` draws each segment along the target alone, once at 10 and once at its identity.
    """
    line = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") if isinstance(x, str) else F.lit(str(x)) for x in c])
    if coverage:
        parts = [line("x1", 10, "identity"), line("x2", 10, "identity"), F.lit("\n"), line("x1", "identity", 0), line("x2", "identity", 0)]
    else:
        parts = [line("x1", "y1", "identity"), line("x2", "y2", "identity")]
    return rows.orderBy("identity", "x1", "y1", "x2", "y2").select(F.concat(F.concat_ws("\n", *parts), F.lit("\n\n")).alias("value"))


def write_plot(rows: DataFrame, path: str, coverage: bool = False) -> None:
    """Folders ``forward`` and ``reverse`` of plot data, and ``broken`` if the rows tell; each begins with a point at zero."""
    spark = rows.sparkSession
    kinds = {"forward": F.col("forward"), "reverse": ~F.col("forward")}
    if "broken" in rows.columns:
        kinds["broken"] = F.col("broken")
    head = spark.createDataFrame([("0 0 0\n0 0 0\n\n",)], "value string")
    for name, kept in kinds.items():
        head.coalesce(1).union(plot_lines(rows.where(kept), coverage)).write.mode("overwrite").text(f"{path}/{name}")
