"""Reading sequences by name from an indexed FASTA file, and making the index.

An index line (``.fai``) says where a sequence's bases begin and how its lines are cut. So what is wanted is chosen in the
index, which Spark reads and filters like any table; it comes to ranges of bytes, long sequences being cut into several;
ranges are dealt out over all tasks, and only they are read. Files that are compressed in blocks (bgzip) are read with
their block index (``.gzi``) beside them. Ranges are read by pyarrow's file systems, so local and mounted paths, HDFS and object stores.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import settle
from strandweave.sources.sequences import FAI, files_of, numbered

#: Bases of a range; bytes that are scanned at a time for an index, and looked at together.
BASES, SCAN, BLOCK = 8 << 20, 64 << 20, 1 << 20
#: What a task reads of small sequences together.
TOGETHER = 32 << 20


def opened(path: str):
    """A file that can be read at any place."""
    where, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(at)


@lru_cache(maxsize=16)
def block_index(path: str) -> tuple[list[int], list[int]]:
    """Where the blocks of a compressed file begin, packed and unpacked, from the ``.gzi`` beside it."""
    with opened(f"{path}.gzi") as f:
        raw = np.frombuffer(f.read(), np.dtype("<u8"))
    pairs = raw[1 : 1 + 2 * int(raw[0])].reshape(-1, 2)
    return [0, *pairs[:, 0].tolist()], [0, *pairs[:, 1].tolist()]


def unpacked(f, path: str, start: int, size: int) -> tuple[bytes, int]:
    """``size`` bytes from ``start`` on of what a file of compressed blocks holds, and how many bytes were read for them."""
    packed, plain = block_index(path)
    n = bisect_right(plain, start) - 1
    skip = start - plain[n]
    f.seek(packed[n])
    out, rest, touched = bytearray(), b"", 0
    while len(out) < skip + size:
        block = zlib.decompressobj(31)
        while not block.eof:
            if not rest:
                rest = f.read(1 << 16)
                touched += len(rest)
            if not rest:
                return bytes(out[skip:]), touched
            out += block.decompress(rest)
            rest = block.unused_data
    return bytes(out[skip : skip + size]), touched


def _reader(counter: Accumulator | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for b in batches:
            held, texts, size = [], [], 0
            for n, (path, at, count, skip, bases) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "at", "bytes", "skip", "bases")), strict=True)):
                f = files.get(path) or files.setdefault(path, opened(path))
                if path.endswith((".gz", ".bgz")):
                    raw, touched = unpacked(f, path, at, count)
                else:
                    f.seek(at)
                    raw = f.read(count)
                    touched = len(raw)
                if counter is not None:
                    counter.add(touched)
                texts.append(raw.translate(None, b"\r\n")[skip : skip + bases].decode("latin-1"))
                held.append(n)
                size += bases
                if size >= TOGETHER:
                    yield _piece(b, held, texts)
                    held, texts, size = [], [], 0
            if held:
                yield _piece(b, held, texts)
        for f in files.values():
            f.close()

    return read


def _piece(b: pa.RecordBatch, held: list[int], texts: list[str]) -> pa.RecordBatch:
    rows = b.take(pa.array(held))
    return pa.RecordBatch.from_arrays([rows.column("seq_id"), rows.column("start"), pa.array(texts, pa.string())], ["seq_id", "start", "seq"])


def read_index(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """seq_id, file and the columns of an index; by default the one beside the file. Lines count from 0."""
    rows = spark.read.csv(index or f"{path}.fai", sep="\t", schema=f"{FAI}, file string", quote="")
    return numbered(rows, "seq_id").withColumn("file", F.coalesce("file", F.lit(path)))


def ranges(index: DataFrame, bases: int = BASES) -> DataFrame:
    """seq_id, file, start, bases, at, bytes and skip: the pieces that sequences are read in, and where their bytes lie.

    A piece of ``bases`` from ``start`` on begins in a line, whose first ``skip`` bases are another piece's.
    """
    each = index.where("len > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(bases).cast("long"))))
    each = each.withColumn("bases", F.least(F.lit(bases).cast("long"), F.col("len") - F.col("start")))
    line = lambda place: F.expr(f"({place}) div line_bases")
    # From the first line's start; the last line's end is not read.
    first, last = line("start"), line("start + bases - 1")
    at = F.col("offset") + first * F.col("line_width")
    end = F.col("offset") + last * F.col("line_width") + (F.col("start") + F.col("bases") - 1) % F.col("line_bases") + 1
    return each.select("seq_id", "file", "start", "bases", at.alias("at"), (end - at).alias("bytes"), (F.col("start") % F.col("line_bases")).alias("skip"))


def read_pieces(index: DataFrame, bases: int = BASES, counter: Accumulator | None = None) -> DataFrame:
    """seq_id, start and seq of the pieces of an index's sequences, no more than ``bases`` long each.

    ``counter`` adds up the bytes that are read.
    """
    pieces = ranges(index, bases)
    parts = pieces.agg(F.sum("bytes")).first()[0] or 0
    dealt = pieces.repartition(max(1, -(-parts // TOGETHER), min(2 * pieces.sparkSession.sparkContext.defaultParallelism, -(-parts // bases))), "seq_id", "start")
    return dealt.mapInArrow(_reader(counter), "seq_id long, start long, seq string")


def chosen(index: DataFrame, names: DataFrame | list[str] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The lines of an index with a name in ``names`` (a list, or a table of one column ``name``) or of a prefix."""
    if names is None and not prefixes:
        return index
    found = F.lit(False)
    for p in prefixes:
        found = found | F.col("name").startswith(p)
    if isinstance(names, list):
        return index.where(found | F.col("name").isin(names))
    if names is None:
        return index.where(found)
    listed = names.select("name", F.lit(True).alias("_listed")).distinct()
    return index.join(listed, "name", "left").where(found | F.coalesce("_listed", F.lit(False))).drop("_listed").select(*index.columns)


def read_indexed(spark: SparkSession, path: str, names: DataFrame | list[str] | None = None, prefixes: tuple[str, ...] = (), index: str | None = None, bases: int = BASES, counter: Accumulator | None = None) -> DataFrame:
    """seq_id, name, seq, len and file of all names of an indexed file; sequences that are not chosen are empty and not read.

    ``len`` is the length of ``seq``. ``read_pieces`` gives long sequences in pieces instead of whole.
    """
    lines = read_index(spark, path, index)
    lines = settle(lines) if names is not None and not isinstance(names, list) else lines
    pieces = read_pieces(chosen(lines, names, prefixes), bases, counter)
    whole = pieces.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    found = lines.select("seq_id", "name", "file").join(whole, "seq_id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    return found.select("seq_id", "name", "seq", F.length("seq").cast("long").alias("len"), "file")


def _lines(f, start: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines from ``start`` on, ends included; a very long line comes in parts."""
    f.seek(start)
    at, rest = start, b""
    while block := f.read(BLOCK):
        rest += block
        cut = rest.rfind(b"\n") + 1 or (len(rest) if len(rest) > BLOCK and not rest.startswith(b">") else 0)
        for line in rest[:cut].splitlines(True) if b"\r" not in rest else [x + b"\n" for x in rest[:cut].split(b"\n")[:-1]]:
            yield at, line
            at += len(line)
        rest = rest[cut:]
    if rest:
        yield at, rest


def scan_records(f, start: int, end: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Index lines of the records that begin between two places of a file; the last one is followed past the end.

    ValueError if lines of a record, but for its last one, differ in length.
    """
    if start:  # a line that begins before this place belongs to another range
        f.seek(start - 1)
        while (block := f.read(1 << 16)) and b"\n" not in block:
            start += len(block)
        start += block.find(b"\n") if block else 0
    name = None
    length = offset = bases = width = 0
    short = False
    for at, line in _lines(f, start):
        if line.startswith(b">"):
            if name is not None:
                yield name, length, offset, bases, width
                name = None
            if at >= end:
                return
            name, length, offset, bases, width, short = (line[1:].split() or [b""])[0].decode(), 0, at + len(line), 0, 0, False
        elif name is not None:
            text = line.rstrip(b"\r\n")
            if not width:
                bases, width = len(text), len(line)
            elif text and (short or len(text) > bases):
                raise ValueError(f"lines of {name} differ in length")
            short = short or len(text) < bases
            length += len(text)
        elif at >= end:
            return
    if name is not None:
        yield name, length, offset, bases, width


def build_index(spark: SparkSession, path: str, scan: int = SCAN) -> DataFrame:
    """name, len, offset, line_bases, line_width and file of all records of plain FASTA files, by file and place.

    Files are scanned by ranges of ``scan`` bytes; a record belongs to the range that it begins in.
    """
    files = spark.createDataFrame([(str(uri), size) for uri, size in files_of(spark, path)], "file string, size long").where("size > 0")
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(scan).cast("long")))).withColumn("end", F.col("start") + scan)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                with opened(path) as f:
                    rows = list(scan_records(f, start, end))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([path] * len(rows), pa.string())], ["name", "len", "offset", "line_bases", "line_width", "file"])

    return cut.repartition("file", "start").mapInArrow(index, f"{FAI}, file string").orderBy("file", "offset")


def write_index(rows: DataFrame, path: str) -> None:
    """Write index lines as tab-separated text; Spark's folder of parts is read like one file."""
    rows.write.mode("overwrite").csv(path, sep="\t", quote="")


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """Write ``name`` and ``seq`` as FASTA with lines of ``width`` bases."""
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    sequences.select(F.concat(F.lit(">"), "name", F.when(body == "", "").otherwise(F.concat(F.lit("\n"), body)))).write.mode("overwrite").text(path)
