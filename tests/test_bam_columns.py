"""BAM records by the column against the same ones one by one, and the parts of files whose index names few of their records."""

import io
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from porelake.sources import bam, bamcols, bgzf

NAMES = ["c1", "c2"]
COLUMNS = [f.name for f in bam._ARROW]


def records(n, seed=0, odd=False):
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice((0, 1, 7, 50, 333))
        seq = "".join(rng.choice("ACGTNacgtX") for _ in range(size))
        tags = [("fn", "Z", rng.choice(("", "one.pod5"))), ("NM", rng.choice("cCsSiI"), rng.randrange(100)), ("XX", "f", 1.5), ("ts", "i", -i), ("pi", "Z", "parent"), ("XA", "A", b"x"), ("XB", "BS", [1, 2, 3]), ("mv", "Bc", [5, *(rng.randrange(2) for _ in range(rng.randrange(9)))])]
        tags = rng.sample(tags, rng.randrange(len(tags) + 1)) + ([("NM", "C", 7)] if rng.random() < 0.1 else [])
        if odd and i == n // 2:
            tags.append(("MD", "Z", "é"))
        r = {"read_id": rng.choice(("", f"read{i}")), "flag": rng.choice((0, 4, 16)), "chr": rng.choice(("c1", "c2", None)), "pos0": rng.choice((None, rng.randrange(60_000))), "mapq": rng.randrange(256), "seq": seq}
        r |= {"cigar": [(rng.randrange(9), rng.randrange(40_000)) for _ in range(rng.randrange(4))], "qual": rng.choice((None, "I" * size, "!")), "rnext": rng.choice(("=", "*", "c2", None)), "pnext": rng.choice((None, 5)), "tlen": rng.choice((None, -9)), "tags": tags}
        out.append(bam.encode_record(r, {"c1": 0, "c2": 1}) + rng.choice((b"", b"XHH1F\0")))
    return out


def joined(made):
    sizes = np.array([len(r) for r in made])
    return b"".join(struct.pack("<i", len(r)) + r for r in made), np.cumsum(sizes + 4) - sizes, sizes


@pytest.mark.parametrize("odd", [False, True])
def test_decoded_like_one_by_one(odd):
    made = records(400, odd=odd)
    data, at, size = joined(made)
    one = pa.RecordBatch.from_pylist([bam.decode_record(r, NAMES) | {"record": r} for r in made], bam._ARROW)
    assert bam._rows(data, at, size, NAMES, COLUMNS, bam._ARROW).to_pylist() == one.to_pylist()
    if odd:
        with pytest.raises(bamcols.Odd):
            bamcols.decode(data, at, size, NAMES, COLUMNS, bam._ARROW)
    else:
        assert bamcols.decode(data, at, size, NAMES, COLUMNS, bam._ARROW).equals(one)


def test_encoded_like_one_by_one():
    rng, rows = random.Random(3), []
    for i in range(300):
        size, moves = rng.randrange(60), rng.choice((None, [], [0], [0, 2, 3, 4], [1, 7, 7]))
        r = {"read_id": rng.choice((None, "", f"r{i}")), "flag": 16, "chr": rng.choice(("c1", "c9", None)), "pos0": rng.randrange(-1, 500), "mapq": rng.choice((None, 60)), "cigar": rng.choice((None, [], [{"op": 0, "len": 5}, {"op": 4, "len": 3}]))}
        r |= {"rnext": rng.choice((None, "=", "*", "c2")), "pnext": rng.choice((None, 8)), "tlen": rng.choice((None, -(1 << 20))), "seq": rng.choice((None, "ACGTNx"[: size % 7] * 5)), "stride": rng.choice((None, 5)), "moves": moves}
        r |= {"qual": rng.choice((None, "I" * 5, "5" * (5 * min(size % 7, 6)))), "file_name": rng.choice((None, "", "one.pod5")), "nm": rng.choice((None, -1, 0, 9)), "md": None, "parent_read": rng.choice((None, "p")), "split": rng.choice((None, 3)), "trim_start": 1, "num_samples": None}
        rows.append(r)
    kinds = {"read_id": pa.string(), "flag": pa.int32(), "chr": pa.string(), "pos0": pa.int32(), "mapq": pa.int32(), "cigar": pa.list_(pa.struct([("op", pa.int8()), ("len", pa.int32())])), "moves": pa.list_(pa.int32())}
    texts = ("rnext", "seq", "qual", "file_name", "md", "parent_read")
    schema = pa.schema([(c, kinds.get(c, pa.string() if c in texts else pa.int64() if c == "tlen" else pa.int32())) for c in rows[0]])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    names = [(n, 1 << 29) for n in NAMES]
    whole = pa.concat_arrays([b.column("record") for b in bam._encoded(names)(iter([batch]))]).to_pylist()
    bamcols.encode(batch, NAMES)  # nothing in it is odd
    assert whole == bamcols.encode(batch.slice(0, 100), NAMES).to_pylist() + bamcols.encode(batch.slice(100), NAMES).to_pylist()
    for r, got in zip(rows, whole, strict=True):
        tags = [(t, k, r[c]) for t, k, c in bam._TAGS if not (c == "nm" and r[c] == -1)]
        if r["moves"] is not None and r["stride"] is not None:
            mv = [0] * (max(r["moves"], default=0) + 1)
            for m in r["moves"][:-1]:
                mv[m] = 1
            tags.append(("mv", "Bc", [r["stride"], *mv[:-1]]))
        assert got == bam.encode_record(r | {"tags": tags, "cigar": [(c["op"], c["len"]) for c in r["cigar"] or ()]}, {"c1": 0, "c2": 1})


def test_written_and_indexed_like_one_by_one():
    made = sorted(records(3000, 5) + [bam.encode_record({"read_id": "long", "flag": 0, "chr": "c2", "pos0": 70_000, "cigar": [], "seq": "A" * 200_000}, {"c2": 1})], key=lambda r: (struct.unpack_from("<Ii", r)))
    files, starts = [io.BytesIO(), io.BytesIO()], []
    one, index = bgzf.Writer(files[0]), bgzf.Index(2)
    for r in made:
        starts.append(one.write(struct.pack("<i", len(r)) + r))
    one.close()
    all_ = bgzf.Writer(files[1])
    for lo in range(0, len(made), 700):
        bam._append(all_, index, pa.array(made[lo : lo + 700], pa.binary()))
    all_.close()
    assert files[0].getvalue() == files[1].getvalue()
    tid, a, b = bamcols.places(*(lambda d, at, _: (np.frombuffer(d, np.uint8), at))(*joined(made)))
    assert index.unplaced == (tid < 0).sum() > 0
    for t, x, y in ((0, 0, 70_000), (0, 100, 400), (1, 20_000, 20_001), (1, 69_999, 90_000), (1, 50_000, 50_000)):
        over = {s for s, i, j, k in zip(starts, tid, a, b, strict=True) if i == t and j < y and k > x and x < y}
        assert over <= {s for s in starts if any(lo <= s < hi for lo, hi in index.chunks(t, x, y))}
    assert sum(len(c) for bins in index.bins for c in bins.values()) < 3000  # one a run of a bin's records, not one a block


@pytest.mark.parametrize("placed", [False, True])
def test_parts_where_the_index_names_nothing(tmp_path, placed):
    """Reads without a place, or all at one, were a single part whatever their number."""
    rng = random.Random(1)
    rows = [{"read_id": f"r{i}", "flag": 0 if placed else 4, "chr": "c1" if placed else None, "pos0": 9 if placed else -1, "cigar": [(0, 30)] if placed else [], "seq": "".join(rng.choice("ACGT") for _ in range(300))} for i in range(9000)]
    path, index = str(tmp_path / "a.bam"), bgzf.Index(1)
    with open(path, "wb") as f:
        out = bgzf.Writer(f)
        out.write(bam._head([("c1", 100)]))
        bam._append(out, index, pa.array([bam.encode_record(r, {"c1": 0}) for r in rows], pa.binary()))
        out.close()
    with open(path + ".bai", "wb") as f:
        f.write(index.dump())
    parts = bam.splits(path, 100_000)
    got = [[x for b in bam.read_part(path, *p, ["read_id"]) for x in b.column(0).to_pylist()] for p in parts]
    assert len(parts) > 5 and max(map(len, got)) < 3000
    assert [x for p in got for x in p] == [r["read_id"] for r in rows]


def test_region_ends_with_its_last_read(tmp_path, monkeypatch):
    """Reads behind the region, in the same bin of the index, were all decoded."""
    path, index = str(tmp_path / "a.bam"), bgzf.Index(1)
    made = [bam.encode_record({"read_id": f"r{i}", "flag": 0, "chr": "c1", "pos0": i, "cigar": [(0, 30)], "seq": "A" * 300}, {"c1": 0}) for i in range(15_000)]
    with open(path, "wb") as f:
        out = bgzf.Writer(f)
        out.write(bam._head([("c1", 20_000)]))
        bam._append(out, index, pa.array(made, pa.binary()))
        out.close()
    with open(path + ".bai", "wb") as f:
        f.write(index.dump())
    seen, places = [], bamcols.places
    monkeypatch.setattr(bamcols, "places", lambda buf, at: seen.append(len(at)) or places(buf, at))
    got = [x for p in bam.over(path, 1 << 20, "c1:100-200") for b in bam.read_part(path, *p, ["read_id"], "c1:100-200") for x in b.column(0).to_pylist()]
    assert got == [f"r{i}" for i in range(71, 200)] and sum(seen) < 5000


def test_reads_at_a_bins_end_are_few_chunks(tmp_path):
    """Reads over the end of a bin stand between others of the lower bin, and each was a chunk of its own, and each chunk a part of a region."""
    path, index = str(tmp_path / "a.bam"), bgzf.Index(1)
    made = [bam.encode_record({"read_id": f"r{i}", "flag": 0, "chr": "c1", "pos0": 16_000 + i // 10, "cigar": [(0, 400 if i % 2 else 20)], "seq": "ACGT"}, {"c1": 0}) for i in range(4000)]
    with open(path, "wb") as f:
        out = bgzf.Writer(f)
        out.write(bam._head([("c1", 40_000)]))
        bam._append(out, index, pa.array(made, pa.binary()))
        out.close()
    with open(path + ".bai", "wb") as f:
        f.write(index.dump())
    assert sum(len(c) for bins in index.bins for c in bins.values()) < 30
    parts = bam.over(path, 1 << 20, "c1:16300-16384")
    got = [x for p in parts for b in bam.read_part(path, *p, ["read_id"], "c1:16300-16384") for x in b.column(0).to_pylist()]
    assert len(parts) == 1 and got == [f"r{i}" for i in range(4000) if 16_000 + i // 10 < 16_384 and 16_000 + i // 10 + (400 if i % 2 else 20) > 16_300]
