"""Near-duplicate mapping of texts, fragment against fragment, by MinHash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import kmers as K
from strandweave.functions.stats import j2md_column, md2j
from strandweave.operators import pairs, sketch
from strandweave.operators.spread import spread_join
from strandweave.session import settle


def text_sketches(sequences: DataFrame, length: int, k: int, s: int, algorithm: str) -> DataFrame:
    frags = K.fragments(sequences, length, k)
    return sketch.fragment_sketches(frags, k, s, algorithm, "text")


def _classes(sequences: DataFrame, length: int, k: int, s: int, percent: float, algorithm: str) -> tuple[DataFrame, DataFrame]:
    """Classes of fragments with equal sketches (``own``, ``class``: its first fragment), and the fragments of each."""
    marks = settle(text_sketches(sequences, length, k, s, algorithm).select("seq_id", "frag_no", "hash"))
    kept = marks
    if percent:
        counts = sketch.seed_counts(marks)
        kept = sketch.drop_seeds(marks, sketch.frequent_seeds(counts, sketch.frequency_threshold(sketch.frequency_histogram(counts), percent)))
    sized = settle(kept.groupBy("seq_id", "frag_no").agg(F.sort_array(F.collect_list("hash")).alias("own")))  # at most a sketch a fragment
    classes = settle(sized.groupBy("own").agg(F.min(F.struct("seq_id", "frag_no")).alias("class")))
    return classes, sized.join(classes, "own").select("class", "seq_id", "frag_no")


def _links(classes: DataFrame, k: int, identity: float, percent: float) -> DataFrame:
    """Pairs of classes, also of one with itself, whose shared seeds imply ``identity``, with shared, jaccard and identity."""
    seeds = classes.select("class", F.size("own").alias("size"), F.explode("own").alias("hash"))
    left, right = (seeds.select("hash", F.col("class").alias(f"{c}_class"), F.col("size").alias(f"{c}_size")) for c in "ab")
    both = (left.join(right, "hash") if percent else spread_join(left, right, "hash")).where("a_class <= b_class")
    shared = both.groupBy("a_class", "b_class").agg(F.count(F.lit(1)).alias("shared"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"))
    jaccard = F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))
    return shared.withColumn("jaccard", jaccard).withColumn("identity", 1 - j2md_column(F.col("jaccard"), k)).where(F.col("identity") >= identity)


def similar_classes(sequences: DataFrame, length: int = 200, k: int = 12, s: int = 20, identity: float = 0.9, percent: float = 0.1, algorithm: str = "xxhash64") -> tuple[DataFrame, DataFrame]:
    """The same as ``similar_fragments`` without spreading copies: links of classes, and the members of each class.

    Links have a_id, a_frag_no, b_id and b_frag_no (the first fragments of two different classes, or of one that has
    several), shared, jaccard and identity; members have class_id and class_frag_no beside seq_id and frag_no. A group of n
    copies is n rows here, not n * n / 2.
    """
    classes, members = _classes(sequences, length, k, s, percent, algorithm)
    several = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("a_class"), F.lit(True).alias("_several"))
    links = _links(classes, k, identity, percent).join(several, "a_class", "left").where("a_class <> b_class or _several")
    named = [F.col(f"{c}_class.{f}").alias(f"{c}_{n}") for c in "ab" for f, n in (("seq_id", "id"), ("frag_no", "frag_no"))]
    return (
        links.select(*named, "shared", F.round("jaccard", 6).alias("jaccard"), F.round("identity", 6).alias("identity")),
        members.select(F.col("class.seq_id").alias("class_id"), F.col("class.frag_no").alias("class_frag_no"), "seq_id", "frag_no"),
    )


def similar_fragments(sequences: DataFrame, length: int = 200, k: int = 12, s: int = 20, identity: float = 0.9, percent: float = 0.1, algorithm: str = "xxhash64") -> DataFrame:
    """Pairs of fragments of different sequences, the later one first, whose shared seeds imply ``identity``.

    The ``percent`` most frequent seeds go first, as they tell nothing and are what would skew the comparison; a fragment that
    loses all of its seeds is in no pair, and Jaccard and sizes are of what is left of the sketches. With ``percent`` 0 every
    seed stays. Seeds go to blocks of sequences and each two blocks are compared in one task, so pairs that share a seed
    are never on disk; copies are all compared, see ``similar_classes`` for groups of them.
    """
    often = (lambda histogram: sketch.frequency_threshold(histogram, percent)) if percent else None
    found = pairs.similar_pairs(text_sketches(sequences, length, k, s, algorithm), sequences, often, md2j(1 - identity, k))
    jaccard = F.col("shared") / (F.col("q_size") + F.col("t_size") - F.col("shared"))
    found = found.withColumn("jaccard", jaccard).withColumn("identity", 1 - j2md_column(F.col("jaccard"), k)).where(F.col("identity") >= identity)
    return found.select("q_id", "q_frag_no", "t_id", "t_frag_no", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("identity", 6).alias("identity"))
