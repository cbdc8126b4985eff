"""Mixing sources to target weights with hash thresholds.

Each document has a fixed hash. A source takes the documents whose hash lies below a threshold (and, where
its target exceeds its size, all of them once before). The threshold that meets the budget is found from
sums of sizes by source and leading hash bits; only the bucket in which the budget runs out is looked into
again, with further bits. Nothing is sorted but the hashes of the last such bucket. Thresholds are nested: a
larger budget takes all that a smaller one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import join_small, settle

#: Weights of the sources by code point, repeating; share of all sizes that is taken; most repeats of a source.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Bits of the hash; those left over after each look at a histogram.
BITS, SHIFTS = 60, (48, 36)


def document_hash() -> Column:
    """60 bits that depend on doc_id and text alone, so that reruns agree."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of each row."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.cast("long").alias("size"), document_hash().alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source: shares by weight, none above its most repeats.

    Sources by how soon they reach their bound: those before the first that stays below it are full, and the
    others share what is left by weight. This is what repeated resharing of the excess comes to.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    total = total.withColumn("_weight", weight.cast("double")).withColumn("_most", (REPEATS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    level = left / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    total = total.withColumn("_level", level).withColumn("_rank", F.row_number().over(order))
    below = F.when(F.col("_level") <= F.col("_most") / F.col("_weight"), F.struct("_rank", "_level"))
    share = F.min(below).over(everything)["_level"]
    return total.select("source", "source_size", F.least(F.col("_most"), share * F.col("_weight")).alias("target"))


def thresholds(sizes: DataFrame) -> tuple[DataFrame, int]:
    """Per source: source_size, target, ``_whole`` (times it is taken whole) and ``_below``; and the row count.

    Documents with a hash under ``_below`` are taken once more. Of the two thresholds next to the budget the
    nearer one is used, so a source misses its target by at most half of a document (or of documents of
    equal hash, which are repeated rows).
    """
    goal = targets(sizes)
    whole = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    goal = goal.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    goal = settle(goal.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")), 1)
    count = goal.count()
    at, bits = goal, BITS
    by_bucket = Window.partitionBy("source").orderBy("_bucket")
    for shift in (*SHIFTS, 0):
        near = at.select(F.col("source").alias("_source"), "_prefix", "_before", "_rest")
        rows = join_small(sizes, near, sizes["source"].eqNullSafe(near["_source"]), "inner", count)
        rows = rows.where(F.shiftright("h", bits) == F.col("_prefix"))
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
        sums = sums.withColumn("_to", F.col("_before") + F.sum("_sum").over(by_bucket))
        cut = sums.where("_to > _rest").groupBy("source").agg(F.min(F.struct("_bucket", "_to", "_sum")).alias("_cut"), F.first("_rest").alias("_rest"))
        at, bits = settle(cut.select("source", F.col("_cut._bucket").alias("_prefix"), (F.col("_cut._to") - F.col("_cut._sum")).alias("_before"), "_rest", F.col("_cut._to").alias("_to")), 1), shift
    nearer = F.when(F.col("_to") - F.col("_rest") < F.col("_rest") - F.col("_before"), F.col("_prefix") + 1).otherwise(F.col("_prefix"))
    cuts = at.select(F.col("source").alias("_source"), nearer.alias("_below"))
    # A source without a cut is used up by its budget: every document is taken.
    out = goal.join(cuts, goal["source"].eqNullSafe(cuts["_source"]), "left")
    return settle(out.select("source", "source_size", "target", "_whole", F.coalesce("_below", F.lit(1 << BITS)).alias("_below")), 1), count


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and words taken (repeats counted) of each document row.

    A null text has size 0; a null source is a source of its own, last in order; repeated rows share a hash
    and are taken or left together; documents of size 0 take 0. An empty table gives no row.
    """
    sizes = settle(sized(docs))
    found, count = thresholds(sizes)
    found = found.withColumnRenamed("source", "_source")
    joined = join_small(sizes, found, sizes["source"].eqNullSafe(found["_source"]), "inner", count)
    copies = F.col("_whole") + F.when(F.col("h") < F.col("_below"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: left out, once, or repeated, with all their columns."""
    found, count = thresholds(settle(sized(docs)))
    found = found.select(F.col("source").alias("__sw_source"), F.col("_whole").alias("__sw_whole"), F.col("_below").alias("__sw_below"))
    hashed = docs.withColumn("__sw_h", document_hash())
    joined = join_small(hashed, found, hashed["source"].eqNullSafe(found["__sw_source"]), "inner", count)
    copies = F.col("__sw_whole") + F.when(F.col("__sw_h") < F.col("__sw_below"), 1).otherwise(0)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias("__sw_copy")).drop("__sw_copy")


ORACLE = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as wt,
  (2 * source_size)::double as most from s),
l as (select *, ({SHARE} * sum(source_size) over ()::double - coalesce(sum(most) over b, 0)) / (sum(wt) over () - coalesce(sum(wt) over b, 0)) as lev,
    row_number() over (order by most / wt, source asc nulls last) as rk
  from w window b as (order by most / wt, source asc nulls last rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, least(most, (select arg_min(lev, rk) from l where lev <= most / wt) * wt) as target from l),
t as (select *, case when target >= source_size then 1 else 0 end as whole, target - case when target >= source_size then source_size else 0 end as rest from g),
c as (select source, h, sum(size) as n, sum(sum(size)) over (partition by source order by h) as upto from d group by source, h),
x as (select t.source, arg_min(struct_pack(h := c.h, upto := c.upto, n := c.n), c.h) as cut, any_value(rest) as rest
  from t join c on t.source is not distinct from c.source where c.upto > t.rest group by t.source),
y as (select source, case when cut.upto - rest < rest - (cut.upto - cut.n) then cut.h + 1 else cut.h end as below from x)
select d.doc_id, d.size, t.source_size, t.target, (d.size * (t.whole + case when d.h < coalesce(y.below, 1152921504606846976) then 1 else 0 end))::bigint as taken
from d join t on d.source is not distinct from t.source left join y on d.source is not distinct from y.source
"""
