"""Files in splits: POD5, BAM without an index, one sorted BAM, FASTA."""

import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from porelake import schemas
from porelake.operators import reads
from porelake.sources import bam, bgzf, fasta, pod5, vbz

from .test_engine import rows

# --- POD5


def signals(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(str(uuid.UUID(int=i + 1)), rng.integers(-(2**15), 2**15, rng.integers(0, 3000)).astype(np.int16), float(i), 0.5) for i in range(n)]


def test_vbz_keeps_every_sample():
    rng = np.random.default_rng(1)
    for x in ([], [5], [-32768, 32767, -32768, 0], rng.integers(-32768, 32768, 1001), 500 + np.cumsum(rng.integers(-9, 10, 5000)), [7] * 17):
        x = np.asarray(x, np.int16)
        assert (vbz.unpack(vbz.pack(x), len(x)) == x).all()
    # by hand: 1, -1, 300 differ by 1, -2, 301: folded 2, 3, 602; keys 0, 0, 1
    import pyarrow as pa

    assert pa.input_stream(pa.py_buffer(vbz.pack(np.array([1, -1, 300], np.int16))), compression="zstd").read() == bytes([0b100, 2, 3, 602 & 255, 602 >> 8])
    with pytest.raises(ValueError, match="number of samples"):
        vbz.unpack(vbz.pack(np.arange(9, dtype=np.int16)), 10)


def test_pod5_ranges_of_reads(tmp_path):
    made = signals(11)
    w = pod5.Writer(str(tmp_path / "a.pod5"), per=3, piece=700, reads_per=4)
    for r in made:
        w.add(*r)
    w.close()
    f = pod5.File(str(tmp_path / "a.pod5"))
    for a, b in ((0, 11), (3, 9), (10, 11), (5, 5)):
        for got, want in zip(f.records(a, b), made[a:b], strict=True):
            assert got[0] == want[0] and (got[1] == want[1]).all() and got[2:] == want[2:]
    cuts = pod5.splits(str(tmp_path / "a.pod5"), 5000)
    assert len(cuts) > 3 and cuts[0][0] == 0 and cuts[-1][1] == 11 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    raw = (tmp_path / "a.pod5").read_bytes()
    for bad in (raw[:-9], raw[:40], b"", raw[:-8] + b"01234567"):
        (tmp_path / "bad.pod5").write_bytes(bad)
        with pytest.raises(ValueError, match="not a POD5"):
            pod5.footer(str(tmp_path / "bad.pod5"))


def test_pod5_signals_of_plain_numbers(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pod5, "_SIGNAL", pa.schema([pod5._SIGNAL.field(0), ("signal", pa.large_list(pa.int16())), pod5._SIGNAL.field(2)]))
    monkeypatch.setattr(vbz, "pack", lambda x: x.tolist())
    made = signals(5, 3)
    w = pod5.Writer(str(tmp_path / "a.pod5"), per=2, piece=400)
    for r in made:
        w.add(*r)
    w.close()
    assert all((a[1] == b[1]).all() for a, b in zip(pod5.File(str(tmp_path / "a.pod5")).records(0, 5), made, strict=True))


def test_pod5_in_spark(spark, tmp_path):
    made = [(f"f{i % 2}.pod5", i_, s.tolist() if i != 4 else None, o, c) for i, (i_, s, o, c) in enumerate(signals(23, 2))] + [(None, str(uuid.UUID(int=99)), [1, 2], 0.0, 1.0)]
    df = spark.createDataFrame(made, schemas.RAW_READS).repartition(3)
    done = rows(pod5.write_pod5(df, str(tmp_path / "p"), most=9000))
    assert sum(r[2] for r in done) == 24 and {os.path.basename(r[1]) for r in done} >= {"f0.pod5", "f0.part1.pod5", "none.pod5"}
    want = sorted((i, s or [], o, c) for _, i, s, o, c in made)
    for split in (2000, 64 << 20):
        got = pod5.read_pod5(spark, str(tmp_path / "p"), split)
        assert rows(got.select("read_id", "signal", "offset", "scale")) == want
        assert {r.file_name for r in got.collect()} == {os.path.basename(r[1]) for r in done}
    assert pod5.read_pod5(spark, str(tmp_path / "p"), 2000).rdd.getNumPartitions() > len(done) == pod5.read_pod5(spark, str(tmp_path / "p")).rdd.getNumPartitions()
    assert pod5.write_pod5(df.limit(0), str(tmp_path / "none")).count() == 0
    os.makedirs(tmp_path / "empty")
    assert pod5.read_pod5(spark, str(tmp_path / "empty")).count() == 0


# --- BAM

NAMES = [("z", 1_000_000), ("a", 500_000)]


def alignments(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lost = i % 40 == 0
        length = int(rng.integers(1, 900))
        # a name and a tag with what looks like a block, and records over several blocks
        fn = "x" * 150_000 if i % 97 == 7 else "\x1f" + "y" * int(rng.integers(0, 300))
        out.append({"read_id": f"r{i}", "flag": 4 if lost else 16 * (i % 2), "chr": "*" if lost else NAMES[i % 2][0], "pos0": -1 if lost else int(rng.integers(0, 499_000)), "mapq": i % 61,
                    "cigar": [] if lost else [("M", length)], "seq": "".join(rng.choice(list("ACGT"), length)), "qual": None, "tags": {"fn": ("Z", fn), "mv": ("Bc", [5, 1, 0, 1])}})
    return out


def load(spark, path, **options):
    spark.dataSource.register(bam.BamSource)
    reader = spark.read.format("bam")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path)).select("read_id", "flag", "chr", "pos0", "mapq", "cigar", "seq", "file_name", "mv")


def test_bam_without_index_in_splits(spark, tmp_path):
    bam.write_bam(str(tmp_path / "in.bam"), NAMES, alignments(600))
    size = os.path.getsize(tmp_path / "in.bam")
    want = rows(load(spark, tmp_path / "in.bam"))
    assert len(want) == 600
    for parts in (3, 50):
        got = load(spark, tmp_path / "in.bam", split=size // parts)
        assert got.rdd.getNumPartitions() >= parts and rows(got) == want


def test_stored_blocks_with_false_magic(spark, tmp_path):
    """Blocks that aren't compressed, so that their data, with what looks like blocks and records, is in the file as it is."""
    made = alignments(60, 4)
    bam.write_bam(str(tmp_path / "in.bam"), NAMES, made)
    with open(tmp_path / "in.bam", "rb") as f:
        data = bgzf.Reader(f).read(1 << 30)
    import struct
    import zlib

    fake = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0\x50\0" + b"q" * 20
    out = bytearray()
    head = bytearray(data)
    for i, at in enumerate(range(0, len(head), 5000)):
        part = bytes(head[at : at + 5000])
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    with open(tmp_path / "raw.bam", "wb") as f:
        f.write(bytes(out) + bgzf.EOF)
    want = rows(load(spark, tmp_path / "raw.bam"))
    assert len(want) == 60 and rows(load(spark, tmp_path / "raw.bam", split=4000)) == want
    with open(tmp_path / "false.bin", "wb") as f:
        f.write(fake + bytes(out) + bgzf.EOF)
    with open(tmp_path / "false.bin", "rb") as f:
        assert bgzf.next_block(f, 0, 1 << 30) == len(fake) and bgzf.next_block(f, 0, 5) is None and bgzf.next_block(f, len(fake) + len(out) + 28, 1 << 40) is None


@pytest.mark.parametrize("long", [False, True])
def test_one_sorted_file(spark, tmp_path, long):
    names = [("z", 1_000_000), ("a", 700_000_000 if long else 500_000)]
    made = alignments(500, 1)
    if long:
        for r in made:
            r["pos0"] += 600_000_000 if r["chr"] == "a" else 0
    bam.write_bam(str(tmp_path / "in.bam"), names, made)
    raw = bam.read_raw(spark, str(tmp_path / "in.bam"))
    text = b"@HD\tVN:1.5\tSO:unsorted\n@RG\tID:one\n@CO\tkept\n"
    path = str(tmp_path / "out.bam")
    assert bam.write_one(raw, names, path, text, parts=5) == 500
    assert sorted(os.listdir(tmp_path)) == ["in.bam", "out.bam", "out.bam.csi" if long else "out.bam.bai"]
    assert bam.heads_of(path) == (b"@HD\tVN:1.5\tSO:coordinate\n@RG\tID:one\n@CO\tkept\n", names)
    whole = load(spark, path)
    assert rows(whole) == rows(load(spark, tmp_path / "in.bam")) == rows(load(spark, path, split=3000)) and load(spark, path, split=3000).rdd.getNumPartitions() > 5
    order = [({"z": 0, "a": 1}.get(r.chr, 2), r.pos0) for r in load(spark, path, split=1 << 40).collect()]
    assert order == sorted(order, key=lambda o: (o[0], o[1] if o[0] < 2 else 0))
    every = whole.withColumn("end", F.col("pos0") + F.greatest(F.lit(1), F.coalesce(F.col("cigar")[0]["len"], F.lit(1)))).filter("chr is not null and pos0 >= 0")
    base = 600_000_000 if long else 0
    for name, a, b in (("z", 0, 1_000_000), ("z", 16_000, 17_000), ("a", base + 200_000, base + 200_001), ("a", base + 1, base + 300_000), ("a", base + 499_990, base + 500_000), ("z", 999_000, 1_000_000)):
        want = rows(every.filter((F.col("chr") == name) & (F.col("pos0") < b) & (F.col("end") > a)).select("read_id"))
        assert rows(load(spark, path, region=f"{name}:{a}-{b}").select("read_id")) == want
    assert load(spark, path, region="nowhere:0-5").count() == 0
    assert bam.write_one(raw.limit(0), names, str(tmp_path / "none.bam")) == 0 and load(spark, tmp_path / "none.bam").count() == 0
    with pytest.raises(Exception, match="needs an index"):
        load(spark, tmp_path / "in.bam", region="z:0-5").count()


@pytest.mark.parametrize("heavy", [False, True])
def test_alignments_as_one_file(spark, tmp_path, heavy):
    """Each is made and encoded once; as write_one(encode()) has them."""
    seen, names = str(tmp_path / "seen"), [("z", 1 << 20), ("a", 1 << 20)]
    place = F.lit(77) if heavy else F.expr("cast(id * 7919 % 900000 as int)")

    def base(i):
        with open(seen, "a") as f:
            f.write("x")
        return "ACGT"[i % 4]

    chr_ = F.lit("a") if heavy else F.expr("element_at(array('z', 'a', 'other', null), cast(id % 4 + 1 as int))")
    rows_ = spark.range(400).select(
        F.concat(F.lit("r"), "id").alias("read_id"), F.when(F.col("id") % 5 == 0, 4).otherwise(0).alias("flag"), chr_.alias("chr"), place.alias("ref_start"), F.lit(9).alias("mapq"),
        F.expr("array(named_struct('op', cast(0 as tinyint), 'len', 40))").alias("cigar"), F.udf(base, "string")("id").alias("seq"), (F.col("id") % 5 != 0).alias("is_mapped"),
    )
    path = str(tmp_path / "one.bam")
    assert bam.write_alignments(rows_, names, path, parts=6) == 400 and os.path.getsize(seen) == 400
    assert bam.write_one(bam.encode(rows_, names), names, str(tmp_path / "two.bam"), parts=6) == 400
    got = load(spark, path, split=1 << 40).collect()
    assert rows(load(spark, path)) == rows(load(spark, str(tmp_path / "two.bam"))) == rows(load(spark, path, split=500))
    order = [({"z": 0, "a": 1}.get(r.chr, 2), r.pos0) for r in got]
    assert order == sorted(order) and {r.chr for r in got} == {None, "a"} | ({"z"} if not heavy else set())
    over = lambda p, where: rows(load(spark, p, region=where).select("read_id"))
    assert over(path, "a:100-500000") == over(str(tmp_path / "two.bam"), "a:100-500000") and over(path, "a:77-78") == over(str(tmp_path / "two.bam"), "a:77-78")
    assert bam.write_alignments(rows_.limit(0), names, str(tmp_path / "none.bam")) == 0 and load(spark, str(tmp_path / "none.bam")).count() == 0


def test_reads_at_one_place_go_to_many_parts():
    names = [("a", 100)]
    schema = pa.schema([("read_id", pa.string()), ("flag", pa.int32()), ("chr", pa.string()), ("pos0", pa.int32())])
    batch = pa.RecordBatch.from_pylist([{"read_id": f"r{i}", "flag": 0, "chr": "a" if i < 900 else None, "pos0": 5 if i < 900 else -1} for i in range(1000)], schema)
    made = pa.array([f"record{i}".encode() for i in range(1000)], pa.binary())
    got = bam._dealt(batch, made, {n: i for i, (n, _) in enumerate(names)}, np.array([5, 5, 5, 5], np.int64))
    sizes = np.bincount(got.column("part").to_numpy(), minlength=5)
    assert len(sizes) == 5 and sizes[:4].min() > 130 and sizes[4] > 230
    key = sorted(zip(got.column("place").to_pylist(), got.column("h").to_pylist(), got.column("part").to_pylist(), strict=True))
    assert [k[2] for k in key] == sorted(k[2] for k in key)


def test_bins():
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 15) == 585 and bgzf.bin_of(0, 1 << 29) == 0 and bgzf.depth_for(1 << 29) == 5 and bgzf.depth_for((1 << 29) + 1) == 6
    for depth in (5, 6):
        for a, b in ((0, 1), (16_383, 16_385), (5_000_000, 5_000_500), (1, 1 << 26)):
            assert bgzf.bin_of(a, b, depth) in bgzf.bins_over(a, b, depth) and bgzf.bin_of(a, b, depth) in bgzf.bins_over(b - 1, b, depth)


# --- FASTA


def plain_fasta(texts, size):
    """The files' texts, in order -> {name: sequence}."""
    found = {}
    for text in texts:
        name, seq, records = None, [], []
        for line in text.replace("\r\n", "\n").split("\n"):
            if line.startswith(">"):
                records.append((name, "".join(seq)))
                name, seq = line[1:].split(" ")[0], []
            else:
                seq.append("".join(line.split()).upper())
        for name, seq in [*records, (name, "".join(seq))]:
            if name and seq:
                found[name] = seq
    return found


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_fasta_in_splits(spark, tmp_path, split, monkeypatch):
    rng = np.random.default_rng(split)
    dna = lambda n, w: "\n".join("".join(rng.choice(list("acgtN"), min(w, n - i))) for i in range(0, n, w))
    one = "lost before\n>c1 a->b note\n" + dna(900, 60) + "\n>empty\n>c2\r\n" + dna(300, 50).replace("\n", "\r\n") + "\r\n>c3>x y\n" + dna(7, 3) + "\n\n  ac gt \n>c1b\nA\n>\nACGT\n>dup\n" + dna(50, 10) + "\n>dup again\nTT\n>dup\n\n"
    two = ">late\n" + dna(2000, 61) + "\n>c2 in a later file\nGATTACA"
    (tmp_path / "1.fa").write_bytes(one.encode())
    (tmp_path / "2.fa").write_bytes(two.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        want = plain_fasta([one, two], 100)
        assert want["c1"] != want["c2"] == "GATTACA" and want["dup"] == "TT" and set(want) == {"c1", "c2", "c3>x", "c1b", "dup", "late"}
        assert {r.chr: r.seq for r in fasta.read_fasta(spark, str(tmp_path)).collect()} == want
        parts = fasta.read_chunks(spark, str(tmp_path), 100)
        monkeypatch.setattr(fasta, "PIECE", 70)
        got = {}
        for r in parts.orderBy("chr", "chunk").collect():
            assert r.at == 100 * r.chunk == len(got.get(r.chr, ""))
            got[r.chr] = got.get(r.chr, "") + r.seq
        assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reference_chunks_keep_repeated_reads(spark):
    ref = spark.createDataFrame([("c", "ACGT" * 700_000)], schemas.REFERENCE)
    places = [(0, 10), (999_990, 1_000_010), (999_990, 1_000_010), (2_799_990, 2_800_000), (2_799_995, 2_800_005), (5_000_000, 5_000_010)]
    a = spark.createDataFrame([("c", s, e, e - s) for s, e in places] + [("d", 0, 5, 5)], "chr string, ref_start int, ref_end int, ref_len int")
    got = [rows(reads.join_reference(a, ref, n).select("ref_start", "ref_seq")) for n in (1 << 30, 0)]
    seq = "ACGT" * 700_000
    assert got[0] == got[1] == sorted((s, seq[s:e]) for s, e in places if s < len(seq))
