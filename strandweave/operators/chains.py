"""Chaining of mapped fragments, and filters on chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.graph import components
from strandweave.operators.ordered import running_total

FIELDS = ["q_start", "q_end", "ref_start", "ref_end", "strand"]


def chain_links(mappings: DataFrame, gap: int) -> DataFrame:
    """map_id and next_id: each mapping's nearest later one on the same query, target and strand.

    A later one starts on the target at most ``gap`` past this one's end, runs the same way along the query and lies
    at a distance under ``gap``; of those the one with least distance and least shift between axes is taken.
    A range join on bins of the target keeps this from pairing all mappings of a query.
    """
    keys = ["q_id", "ref_id", "strand"]
    a = mappings.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("map_id", *FIELDS[:4])])
    a = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a_ref_start") / gap), F.floor((F.col("a_ref_end") + gap) / gap))))
    b = mappings.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("map_id", *FIELDS[:4])], F.floor(F.col("ref_start") / gap).alias("_bin"))
    later = F.struct("a_ref_start", "a_q_start", "a_map_id") < F.struct("b_ref_start", "b_q_start", "b_map_id")
    pairs = a.join(b, [*keys, "_bin"]).where(later & (F.col("b_ref_start") <= F.col("a_ref_end") + gap))
    forward = F.col("strand") >= 0
    pairs = pairs.where(F.when(forward, F.col("a_q_start") <= F.col("b_q_start")).otherwise(F.col("a_q_end") >= F.col("b_q_end")))
    dq = F.when(forward, F.greatest(F.col("b_q_start") - F.col("a_q_end"), F.lit(0))).otherwise(F.greatest(F.col("a_q_start") - F.col("b_q_end"), F.lit(0))).cast("double")
    dr = F.greatest(F.col("b_ref_start") - F.col("a_ref_end"), F.lit(0)).cast("double")
    pairs = pairs.withColumn("_d", F.sqrt(dq * dq + dr * dr)).withColumn("_score", (dq - dr) * (dq - dr)).where(F.col("_d") < gap)
    return pairs.groupBy(F.col("a_map_id").alias("map_id")).agg(F.min_by("b_map_id", F.struct(F.col("_d") + F.col("_score"), "b_ref_start", "b_q_start", "b_map_id")).alias("next_id"))


def chain_ids(mappings: DataFrame, links: DataFrame) -> DataFrame:
    """Mappings with ``chain_id``, the smallest map_id of their chain: the components of the links, by rounds of joins.

    No query or target is gathered in one task, however many mappings it has.
    """
    roots = components(links.select(F.col("map_id").alias("a"), F.col("next_id").alias("b")))
    found = mappings.join(roots.select(F.col("node").alias("map_id"), "root"), "map_id", "left")
    return found.withColumn("chain_id", F.coalesce("root", "map_id")).drop("root")


def merge_chains(mappings: DataFrame) -> DataFrame:
    """One row a chain: outer ends, mean identity and complexity, count; the rest from its first mapping."""
    head = F.struct("ref_id", "ref_start", "q_start", "map_id")
    carried = [c for c in mappings.columns if c not in {"chain_id", "q_start", "q_end", "ref_start", "ref_end", "identity", "kmer_complexity", "map_id", "q_id", "ref_id", "strand", "block_len", "n_merged"}]
    merged = mappings.groupBy("q_id", "ref_id", "strand", "chain_id").agg(
        F.min("q_start").alias("q_start"),
        F.max("q_end").alias("q_end"),
        F.min("ref_start").alias("ref_start"),
        F.max("ref_end").alias("ref_end"),
        F.avg("identity").alias("identity"),
        *([F.avg("kmer_complexity").alias("kmer_complexity")] if "kmer_complexity" in mappings.columns else []),
        F.count(F.lit(1)).alias("n_merged"),
        *[F.min_by(c, head).alias(c) for c in carried],
    )
    block = F.greatest(F.col("q_end") - F.col("q_start"), F.col("ref_end") - F.col("ref_start"))
    return merged.withColumn("block_len", block).withColumn("map_id", F.col("chain_id"))


def drop_weak_chains(mappings: DataFrame, block_length: int, segment_length: int) -> DataFrame:
    """Chains of too few fragments for their length, on queries longer than they are."""
    weak = (F.col("q_len") > F.col("block_len")) & (F.col("n_merged") < block_length // segment_length)
    return mappings.where(~weak)


def drop_length_mismatches(mappings: DataFrame, identity: float) -> DataFrame:
    """Mappings whose spans on query and target differ more than the identity allows."""
    ref, query = F.col("ref_end") + 1 - F.col("ref_start"), F.col("q_end") - F.col("q_start")
    return mappings.where(1 - F.abs(ref - query) / query >= min(0.7, identity**3))


def sparsify(mappings: DataFrame, share: float, columns: list[str]) -> DataFrame:
    """A share of the mappings, chosen by a hash of their fields, so reruns agree."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("long")
    return mappings if share >= 1 else mappings.where(drawn % 1_000_000 < int(share * 1_000_000))


def clamp(mappings: DataFrame) -> DataFrame:
    """Places held inside target and query."""
    inside = lambda c, low, high: F.least(F.greatest(F.col(c), F.lit(low)), high)
    last = F.col("ref_len") - 1
    return mappings.withColumns({"ref_start": inside("ref_start", 0, last), "ref_end": inside("ref_end", 0, last), "q_start": inside("q_start", 0, F.col("q_len")), "q_end": inside("q_end", 0, F.col("q_len"))})


def map_quality(identity: Column) -> Column:
    return F.when(identity >= 1, 255).otherwise(F.round(-10 * F.log10(1 - identity)).cast("int"))


def repeats(mappings: DataFrame, length: int, identity: float) -> DataFrame:
    """Mappings of a sequence on itself that show a repeat: long, alike enough and away from the diagonal."""
    away = (F.col("q_name") != F.col("ref_name")) | ((F.abs(F.col("q_start") - F.col("ref_start")) >= 1.5 * length) & (F.abs(F.col("q_end") - F.col("ref_end")) >= 1.5 * length))
    kept = away & (F.col("q_end") - F.col("q_start") + 1 >= length) & (F.col("identity") + 1 >= identity)
    return mappings.where(kept)


def fattest(mappings: DataFrame) -> DataFrame:
    """The longest mapping of each query."""
    order = Window.partitionBy("q_id").orderBy(F.desc(F.col("q_end") - F.col("q_start")), F.desc("identity"), "map_id")
    return mappings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def layout_offsets(lengths: DataFrame, order: list[str]) -> DataFrame:
    """Where each sequence begins when all are laid end to end; ``lengths`` has a row a sequence."""
    return running_total(lengths, order, F.col("len") - 1, "offset")


def locate(points: DataFrame, offsets: DataFrame, width: int) -> DataFrame:
    """The sequence and local place of global places (``pos``), by a range join on bins of ``width``."""
    ranges = offsets.withColumn("stop", F.col("offset") + F.col("len") - 2).where("stop >= offset")
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor(F.col("stop") / width))))
    found = points.withColumn("_bin", F.floor(F.col("pos") / width)).join(binned, "_bin").where("pos between offset and stop")
    return found.withColumn("local_pos", F.col("pos") - F.col("offset")).drop("_bin", "stop")
