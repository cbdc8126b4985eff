"""Indexed FASTA files and FASTQ records."""

import gzip
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strandweave.sources import indexed
from strandweave.sources import sequences as S


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    """A thousand sequences of all lengths, by name, and the file they stand in."""
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("fasta")
    names = {f"s{n}": "".join(rng.choices("ACGT", k=rng.choice([0, 1, 59, 60, 61, 120, 500, 3000]))) for n in range(1000)}
    names["s500"] = "".join(rng.choices("ACGT", k=200_000))
    text = "".join(f">{n} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in names.items())
    (folder / "x.fa").write_text(text)
    return str(folder / "x.fa"), names


@pytest.fixture(scope="module")
def lines(spark, fasta):
    path, _ = fasta
    indexed.write_index(indexed.build_index(spark, path, 10_000), f"{path}.fai")
    return path


def test_three_names_of_a_thousand_touch_only_their_bytes(spark, fasta, lines):
    path, names = fasta
    wanted = ["s7", "s500", "s993"]
    for given in (wanted, spark.createDataFrame([(n,) for n in [*wanted, "s7", "none"]], "name string")):
        counter = spark.sparkContext.accumulator(0)
        got = {r.name: (r.seq_id, r.seq, r.len) for r in indexed.read_indexed(spark, path, given, bases=30_000, counter=counter).collect()}
        assert got == {n: (i, s, len(s)) if n in wanted else (i, "", 0) for i, (n, s) in enumerate(names.items())}
        bases = sum(len(names[n]) for n in wanted)
        assert bases <= counter.value <= bases * 62 / 60 + 60 * 10


def test_a_long_record_is_read_by_several_tasks(spark, fasta, lines):
    path, names = fasta
    index = indexed.chosen(indexed.read_index(spark, path), ["s500"])
    pieces = indexed.read_pieces(index, 20_000)
    assert pieces.rdd.getNumPartitions() > 1 and pieces.select(F.spark_partition_id()).distinct().count() > 1
    assert "".join(r.seq for r in pieces.orderBy("start").collect()) == names["s500"]


def test_prefixes_and_everything(spark, fasta, lines):
    path, names = fasta
    got = {r.name: r.seq for r in indexed.read_indexed(spark, path, prefixes=("s99",)).collect()}
    assert got == {n: s if n.startswith("s99") else "" for n, s in names.items()}
    assert {r.name: r.seq for r in indexed.read_indexed(spark, path).collect()} == names
    scan = indexed.chosen(indexed.read_index(spark, path), prefixes=("s99",))
    assert "StartsWith" in scan._jdf.queryExecution().toString()


def test_compressed_blocks(spark, fasta, lines, tmp_path):
    path, names = fasta
    plain = open(path, "rb").read()
    size, packed, places = 20_000, b"", []
    for at in range(0, len(plain), size):
        if at:
            places.append((len(packed), at))
        made = zlib.compressobj(wbits=31)
        packed += made.compress(plain[at : at + size]) + made.flush()
    (tmp_path / "x.fa.gz").write_bytes(packed)
    (tmp_path / "x.fa.gz.gzi").write_bytes(struct.pack("<Q", len(places)) + b"".join(struct.pack("<QQ", *p) for p in places))
    counter = spark.sparkContext.accumulator(0)
    got = indexed.read_indexed(spark, str(tmp_path / "x.fa.gz"), ["s3", "s500", "s998"], index=f"{path}.fai", bases=30_000, counter=counter).where("len > 0").collect()
    assert {r.name: r.seq for r in got} == {n: names[n] for n in ("s3", "s500", "s998") if names[n]}
    assert counter.value < len(packed) * 1.5 and gzip.open(tmp_path / "x.fa.gz").read() == plain


@given(st.lists(st.integers(0, 40), max_size=8), st.sampled_from(["\n", "\r\n"]), st.integers(1, 12), st.integers(1, 60), st.booleans())
@settings(max_examples=150, deadline=None)
def test_ranges_find_each_record_once(sizes, end, width, step, ended):
    import io

    text = "".join(f">n{i} x{end}" + "".join("A" * min(width, n - a) + end for a in range(0, n, width)) for i, n in enumerate(sizes)).encode()
    text = text if ended else text.removesuffix(end.encode())
    found = [r for a in range(0, len(text), step) for r in indexed.scan_records(io.BytesIO(text), a, a + step)]
    assert [(r[0], r[1]) for r in found] == [(f"n{i}", n) for i, n in enumerate(sizes)]
    for name, length, offset, bases, wide in found:
        if length > bases:
            assert text[offset + wide - len(end) : offset + wide] == end.encode() and bases == width


def test_uneven_lines_have_no_index(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(PythonException, match="differ in length"):
        indexed.build_index(spark, str(tmp_path / "u.fa")).collect()


def test_written_fasta_reads_back(spark, tmp_path):
    rows = [(f"n{i}", "ACGT" * i) for i in range(40)]
    indexed.write_fasta(spark.createDataFrame(rows, "name string, seq string").repartition(3), str(tmp_path / "w"), 12)
    got = S.read_sequences(spark, str(tmp_path / "w"))
    assert {(r.name, r.seq) for r in got.collect()} == set(rows) and sorted(r.seq_id for r in got.collect()) == list(range(40))


RECORDS = [("r1", "ACGTACGTAC", "@IIII+II>I"), ("r2", "", ""), ("r3", "GGG", "@@@"), ("r4", "T" * 300, "+" * 300), ("r5", "AC", ">@")]


def fastq(records, width, end="\n"):
    cut = lambda s: [s[i : i + width] for i in range(0, len(s), width)] or [""]
    return end.join(x for n, s, q in records for x in (f"@{n} d", *cut(s), "+" + n, *cut(q))) + end


@pytest.mark.parametrize("width", [4, 1000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_wrapped_or_not(spark, tmp_path, width, end):
    (tmp_path / "a.fq").write_text(fastq(RECORDS, width, end), newline="")
    with gzip.open(tmp_path / "b.fq.gz", "wt", newline="") as f:
        f.write(fastq(RECORDS[::-1], width, end))
    rows = S.read_sequences(spark, [str(tmp_path / "b.fq.gz"), str(tmp_path / "a.fq")]).orderBy("seq_id").collect()
    assert [(r.name, r.seq) for r in rows] == [r[:2] for r in [*RECORDS[::-1], *RECORDS]] and [r.seq_id for r in rows] == list(range(10))


def test_fastq_without_its_quality(spark, tmp_path):
    for n, text in enumerate(["@a\nACGT\n+\nII\n", "@a\nACGT\n+\nIIIII\n", "@a\nACGT\n+\n"]):
        (tmp_path / f"{n}.fq").write_text(text)
        with pytest.raises(PythonException, match="quality"):
            S.read_sequences(spark, str(tmp_path / f"{n}.fq")).collect()


def test_files_in_the_order_given_without_a_job_for_each(spark, tmp_path):
    paths = []
    for n in range(30):
        (tmp_path / f"{n}.fa").write_text("".join(f">f{n}_{i}\n{'ACGT' * (30 - n)}\n" for i in range(n % 4)))
        paths.append(str(tmp_path / f"{n}.fa"))
    order = paths[::-1]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "")
    rows = S.read_sequences(spark, order)
    assert len(tracker.getJobIdsForGroup("files")) < 6
    got = rows.orderBy("seq_id").collect()
    assert [r.name for r in got] == [f"f{n}_{i}" for n in reversed(range(30)) for i in range(n % 4)]
    assert all(r.file == str(tmp_path / f"{r.name[1:].split('_')[0]}.fa") for r in got)
    (tmp_path / "odd.txt").write_text("hello\n")
    with pytest.raises(ValueError, match="neither"):
        S.read_sequences(spark, str(tmp_path / "odd.txt"))
    with pytest.raises(FileNotFoundError):
        S.read_sequences(spark, str(tmp_path / "none.fa"))
