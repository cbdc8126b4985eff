"""Mapping tables as text: PAF, the older ten-column form, alignment lines and BED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.chains import map_quality

COLUMNS = ["q_name", "q_len", "q_start", "q_end", "strand", "ref_name", "ref_len", "ref_start", "ref_end"]


def _six(c: Column) -> Column:
    """A number with six digits after the point, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")


def to_paf(m: DataFrame, jaccard: bool = False) -> DataFrame:
    """One column ``value``: tab-separated, 0-based, ends exclusive, with identity and complexity tags."""
    tags = [F.concat(F.lit("id:f:"), _six(F.col("identity"))), F.concat(F.lit("kc:f:"), _six(F.col("kmer_complexity")))]
    tags += [F.concat(F.lit("jc:f:"), _six(F.col("conserved") / F.col("sketch_size")))] if jaccard else []
    parts = [F.col(c).cast("string") for c in COLUMNS] + [F.col("conserved").cast("string"), F.col("block_len").cast("string"), map_quality(F.col("identity")).cast("string")]
    return m.select(F.concat_ws("\t", *parts, *tags).alias("value"))


def to_legacy(m: DataFrame) -> DataFrame:
    """One column ``value``: space-separated, ends inclusive, identity in per cent."""
    last = {"q_end": F.col("q_end") - 1, "ref_end": F.col("ref_end") - 1}
    parts = [last.get(c, F.col(c)).cast("string") for c in COLUMNS]
    return m.select(F.concat_ws(" ", *parts, _six(F.col("identity") * 100)).alias("value"))


def parse(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """Mapping columns of either form; lines of fewer than nine fields are dropped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("f", f).where(F.size("f") >= 9)
    at = lambda i: F.get("f", F.lit(i))
    end = 1 if legacy else 0
    kinds = {"q_name": "string", "strand": "string", "ref_name": "string"}
    out = [(at(i).cast(kinds.get(c, "long")) + (end if c in ("q_end", "ref_end") else 0) if c not in kinds else at(i)).alias(c) for i, c in enumerate(COLUMNS)]
    identity = at(9).cast("double") / 100 if legacy else F.regexp_extract("value", r"\tid:f:([0-9.eE+-]+)", 1).try_cast("double")
    return rows.select(*out, identity.alias("identity"))


def read_mappings(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    return parse(spark.read.text(path), legacy)


#: The order of a run's output.
ORDER = ["q_id", "q_start", "ref_id", "ref_start"]


def in_order(m: DataFrame) -> DataFrame:
    """Mappings by query, place in it, target and place there; parts are ranges of that order, so none holds them all."""
    return m.orderBy(*ORDER, "q_end", "ref_end") if {*ORDER} <= {*m.columns} else m


def write_result(m: DataFrame, path: str, p) -> None:
    """Write mappings in the form that a run's parameters ask for: the older lines, or PAF with the Jaccard tag if unmerged."""
    write_mappings(m, path, p.legacy_output, p.no_merge)


def write_mappings(m: DataFrame, path: str, legacy: bool = False, jaccard: bool = False) -> None:
    """Write lines in the final order (``in_order``): the parts, one after another by name, are the whole output."""
    m = in_order(m)
    (to_legacy(m) if legacy else to_paf(m, jaccard)).write.mode("overwrite").text(path)


def write_alignments(a: DataFrame, path: str) -> None:
    """Write alignment lines in the same order."""
    to_alignment_lines(in_order(a)).write.mode("overwrite").text(path)


def to_alignment_lines(a: DataFrame) -> DataFrame:
    """The mapping's legacy line with error rate and cigar behind it."""
    parts = [F.col(c).cast("string") for c in COLUMNS] + [_six(F.col("identity") * 100), _six(F.col("error_rate")), F.col("cigar")]
    return a.select(F.concat_ws(" ", *parts).alias("value"))


def write_bed(rows: DataFrame, path: str) -> None:
    """chrom, start and end, tab-separated."""
    rows.select("chrom", "start", "end").write.mode("overwrite").csv(path, sep="\t")
