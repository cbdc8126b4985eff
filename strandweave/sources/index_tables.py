"""A whole index stored as bucketed tables, so that mapping against it doesn't shuffle it again.

Postings are bucketed and sorted by hash, which is what the seed join joins on, and minmers by target and bin, which is
what the exact sweep joins on. Buckets are part of the files' names; a table over them is declared anew in each session.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.params import MapParams
from strandweave.plans.mapping import Index

#: Parameters that an index is made with; the others are those of a run against it.
MADE_WITH = ("segment_length", "kmer", "kmer_threshold", "alphabet", "algorithm", "skip_prefix", "target_prefix", "target_list")


def _write(rows: DataFrame, path: str, buckets: int, by: list[str]) -> None:
    name = f"index_{uuid.uuid4().hex}"
    rows.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")  # the files stay


def _table(spark: SparkSession, path: str, buckets: int, by: list[str]) -> DataFrame:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name = f"index_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(by)}) sorted by ({', '.join(by)}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def store(index: Index, path: str, buckets: int = 200) -> None:
    """Write an index folder: minmers and postings in so many buckets, targets, frequent seeds and parameters."""
    bins = index.minmers.withColumn("bin", F.floor(F.col("wpos") / index.params.segment_length))
    _write(bins, f"{path}/minmers", buckets, ["seq_id", "bin"])
    _write(index.postings, f"{path}/postings", buckets, ["hash"])
    index.targets.write.mode("overwrite").parquet(f"{path}/targets")
    index.frequent.write.mode("overwrite").parquet(f"{path}/frequent")
    about = json.dumps({"size": index.size, "buckets": buckets, "params": asdict(index.params)})
    index.minmers.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def open_stored(spark: SparkSession, path: str, params: MapParams | None = None) -> Index:
    """An index folder as tables; without ``params`` those that it was made with. ValueError if they can't go with it."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    made = MapParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["params"].items()})
    run = params or made
    for k in MADE_WITH:
        if getattr(run, k) != getattr(made, k):
            raise ValueError(f"the index has {k} {getattr(made, k)}, not {getattr(run, k)}")
    if run.sketch_size not in (None, about["size"]):
        raise ValueError(f"the index has sketches of {about['size']}, not {run.sketch_size}")
    minmers, postings = (_table(spark, f"{path}/{n}", about["buckets"], by) for n, by in (("minmers", ["seq_id", "bin"]), ("postings", ["hash"])))
    return Index(spark.read.parquet(f"{path}/targets"), minmers, postings, spark.read.parquet(f"{path}/frequent"), run, about["size"])
