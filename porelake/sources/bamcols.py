"""BAM records by the column: those of a stretch of bytes are decoded, placed and encoded together in numpy. What doesn't fit the common
forms (tags of other kinds, letters that aren't ASCII, records that are cut off) raises Odd, and goes record by record in bam.py."""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bgzf

#: Bases by their code of four bits.
NIBBLES = "=ACMGRSVTWYHKDBN"
_PAIR = np.array([[ord(NIBBLES[b >> 4]), ord(NIBBLES[b & 15])] for b in range(256)], np.uint8)
_NIBBLE = np.full(256, NIBBLES.index("N"), np.uint8)
_NIBBLE[[ord(c) for c in NIBBLES]] = np.arange(16)
_NIBBLE[[ord(c) for c in NIBBLES.lower()]] = np.arange(16)
#: The fields before a record's name; bytes of a tag's kind, -1 up to a zero, -2 an array.
_HEAD = np.dtype([("tid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("n", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_WIDTH = np.zeros(256, np.int64)
for _kind, _width in zip("AcCsSiIfZHB", (1, 1, 1, 2, 2, 4, 4, 4, -1, -1, -2), strict=True):
    _WIDTH[ord(_kind)] = _width
_FORMS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
#: Tags of an alignment's columns, and their kinds.
TAGS = (("fn", "Z", "file_name"), ("ts", "i", "trim_start"), ("ns", "i", "num_samples"), ("NM", "i", "nm"), ("MD", "Z", "md"), ("pi", "Z", "parent_read"), ("sp", "i", "split"))


class Odd(ValueError):
    pass


def _check(fits) -> None:
    if not np.all(fits):
        raise Odd


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of runs that begin at `starts` and are `lens` long."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _ends(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    _check(out[-1] < 2**31)
    return out.astype(np.int32)


def _bits(valid: np.ndarray | None):
    return None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))


def _strings(lens: np.ndarray, letters: np.ndarray, valid: np.ndarray | None = None, kind=pa.string()) -> pa.Array:
    if kind == pa.string():
        _check(letters < 128)
    return pa.Array.from_buffers(kind, len(lens), [_bits(valid), pa.py_buffer(_ends(lens)), pa.py_buffer(np.ascontiguousarray(letters))])


def _cut(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, valid: np.ndarray | None = None, kind=pa.string()) -> pa.Array:
    lens = lens if valid is None else np.where(valid, lens, 0)
    return _strings(lens, buf[_places(starts, lens)], valid, kind)


def spans(stream: bgzf.Reader, end: int | None, most: int = 1 << 20) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Records that start before a virtual offset, in stretches of about `most` bytes: the bytes, each record's place behind its length, and that
    length."""
    held, limit, more, want = b"", None, stream.next > stream.block, most
    while True:
        parts, have = [held], len(held)
        while more and have < want:
            if end is not None and limit is None and stream.block >= end >> 16:
                limit = have + ((end & 0xFFFF) - stream.i if stream.block == end >> 16 else 0)
            piece = stream.data[stream.i :]
            parts.append(piece)
            have += len(piece)
            more = stream._fill()
        held = b"".join(parts)
        starts, sizes, i, stop = [], [], 0, have if limit is None else min(limit, have)
        while i < stop and i + 4 <= have:
            n = struct.unpack_from("<i", held, i)[0]
            if n < 32:
                raise ValueError("not a record of a BAM file")
            if i + 4 + n > have:
                break
            starts.append(i + 4)
            sizes.append(n)
            i += 4 + n
        if starts:
            yield held, np.array(starts), np.array(sizes)
        if limit is not None and i >= limit:
            return
        if not more:
            if i < have:
                raise ValueError("a BAM file that is cut off")
            return
        held, limit = held[i:], None if limit is None else limit - i
        want = max(most, 2 * len(held))


def _heads(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(buf[at[:, None] + np.arange(32)]).view(_HEAD).ravel()


def _operations(buf: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of operations, and all operations."""
    n = h["ops"].astype(np.int64)
    return n, buf[_places(at + 32 + h["name"], 4 * n)].view("<u4")


def places(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reference, start and end of each record; one base long if it has no operations over the reference, reference -1 without a place."""
    h = _heads(buf, at)
    n, ops = _operations(buf, at, h)
    sums, ends = np.concatenate([[0], np.cumsum(np.where(np.isin(ops & 15, (0, 2, 3, 7, 8)), ops >> 4, 0).astype(np.int64))]), np.cumsum(n)
    start = h["pos"].astype(np.int64)
    return np.where(start >= 0, h["tid"], -1).astype(np.int64), start, start + np.maximum(sums[ends] - sums[ends - n], 1)


def _walk_tags(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By tag: each record's place of its value (-1 without the tag, the last of a repeated one), kind, and the place behind it. All records take
    their next tag at once."""
    names = [t for t, _, _ in TAGS] + ["mv"]
    found = {t: (np.full(len(at), -1), np.zeros(len(at), np.uint8), np.zeros(len(at), np.int64)) for t in names}
    cur, zeros = at.copy(), np.flatnonzero(buf == 0)
    live = np.flatnonzero(cur + 3 <= end)
    while len(live):
        c, last = cur[live], end[live]
        name, kind, v = buf[c].astype(np.int32) << 8 | buf[c + 1], buf[c + 2], c + 3
        width = _WIDTH[kind]
        _check(width != 0)
        after = v + width
        text, array = width == -1, width == -2
        if text.any():
            nth = np.searchsorted(zeros, v[text])
            _check(nth < len(zeros))
            after[text] = zeros[nth] + 1
        if array.any():
            w = v[array]
            _check(w + 5 <= last[array])
            count, each = buf[w[:, None] + np.arange(1, 5)].view("<i4").ravel().astype(np.int64), _WIDTH[buf[w]]
            _check((count >= 0) & (each > 0))
            after[array] = w + 5 + count * each
        _check(after <= last)
        for t in names:
            own = name == (ord(t[0]) << 8 | ord(t[1]))
            if own.any():
                for into, x in zip(found[t], (v, kind, after), strict=True):
                    into[live[own]] = x[own]
        cur[live] = after
        live = live[after + 3 <= last]
    return found


def _numbers(buf: np.ndarray, tag, missing: int | None) -> pa.Array:
    at, kind, _ = tag
    there = at >= 0
    out = np.full(len(at), 0 if missing is None else missing, np.int64)
    for k in np.unique(kind[there]).tolist():
        _check(chr(k) in "cCsSiI")
        own = there & (kind == k)
        form = np.dtype(_FORMS[chr(k)])
        out[own] = np.ascontiguousarray(buf[at[own][:, None] + np.arange(form.itemsize)]).view(form).ravel()
    _check(out < 2**31)
    return pa.array(out.astype(np.int32), mask=None if missing is not None else ~there)


def _text(buf: np.ndarray, tag) -> pa.Array:
    at, kind, after = tag
    there = at >= 0
    _check(_WIDTH[kind[there]] == -1)
    return _cut(buf, at, after - 1 - at, there)


def _moves(buf: np.ndarray, tag) -> pa.Array:
    at, kind, after = tag
    there = at >= 0
    _check(kind[there] == ord("B"))
    subs = np.unique(buf[at[there]])
    _check(len(subs) <= 1 and (not len(subs) or chr(subs[0]) in _FORMS))
    form = np.dtype(_FORMS[chr(subs[0])] if len(subs) else "i1")
    lens = np.where(there, after - at - 5, 0)
    values = buf[_places(at + 5, lens)].view(form).astype(np.int32)
    return pa.Array.from_buffers(pa.list_(pa.int32()), len(at), [_bits(there), pa.py_buffer(_ends(lens // form.itemsize))], children=[pa.array(values)])


def decode(data: bytes, at: np.ndarray, size: np.ndarray, names: list[str], columns: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Records -> the rows that bam.decode_record() gives one by one."""
    buf = np.frombuffer(data, np.uint8)
    h = _heads(buf, at)
    n, name, n_ops = h["n"].astype(np.int64), h["name"].astype(np.int64), h["ops"].astype(np.int64)
    half = (n + 1) // 2
    bases = at + 32 + name + 4 * n_ops
    tags_at = bases + half + n
    _check((n >= 0) & (tags_at <= at + size) & (h["tid"] < len(names)) & (h["mate"] < len(names)))
    tags = _walk_tags(buf, tags_at, at + size)
    known = pa.array([*names, None], pa.string())
    named = lambda t: known.take(pa.array(np.where(t < 0, len(names), t)))

    def cigar():
        _, ops = _operations(buf, at, h)
        both = pa.StructArray.from_arrays([pa.array((ops & 15).astype(np.int8)), pa.array((ops >> 4).astype(np.int32))], ["op", "len"])
        return pa.ListArray.from_arrays(pa.array(_ends(n_ops)), both)

    def seq():
        letters = _PAIR[buf[_places(bases, half)]].ravel()
        if (n & 1).any():
            letters = letters[_places(2 * (np.cumsum(half) - half), n)]
        return _strings(n, letters, n > 0)

    def qual():
        there = n > 0
        there[there] = buf[(bases + half)[there]] != 255
        lens = np.where(there, n, 0)
        return _strings(lens, buf[_places(bases + half, lens)] + np.uint8(33), there)

    made = {
        "read_id": lambda: _cut(buf, at + 32, np.maximum(name - 1, 0)), "flag": lambda: pa.array(h["flag"].astype(np.int32)), "chr": lambda: named(h["tid"]),
        "mapq": lambda: pa.array(h["mapq"].astype(np.int32)), "pos0": lambda: pa.array(h["pos"].astype(np.int32)), "cigar": cigar, "rnext": lambda: named(h["mate"]),
        "pnext": lambda: pa.array(h["mate_pos"].astype(np.int32)), "tlen": lambda: pa.array(h["tlen"].astype(np.int64)), "seq": seq, "qual": qual,
        "mv": lambda: _moves(buf, tags["mv"]), "record": lambda: _cut(buf, at, size, kind=pa.binary()),
    }
    for tag, kind, c in TAGS:
        made[c] = (lambda t=tag: _text(buf, tags[t])) if kind == "Z" else (lambda t=tag, c=c: _numbers(buf, tags[t], -1 if c == "nm" else None))
    return pa.RecordBatch.from_arrays([made[c]() for c in columns], schema=schema)


def _ints(column: pa.Array, missing: int, low: int, high: int) -> np.ndarray:
    out = pc.fill_null(column, missing).to_numpy(zero_copy_only=False).astype(np.int64)
    _check((out >= low) & (out <= high))
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of strings or bytes -> all bytes, each value's place among them and its length (of a null one 0)."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    lens = np.diff(at)
    if column.null_count:
        lens = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lens)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], lens


def _ascii(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters, and each value's number of them."""
    buf, at, lens = bytes_of(column)
    letters = buf[_places(at, lens)]
    _check(letters < 128)
    return letters, lens


def encode(batch: pa.RecordBatch, names: list[str], before: int = 0) -> pa.Array:
    """Rows of an alignment's columns -> the records that bam.encode_record() makes one by one, without their lengths, or with them in `before` = 4
    bytes."""
    col, rows = batch.column, batch.num_rows
    _check(len(set(names)) == len(names) and not {"*", "="} & set(names))
    known = pa.array(names, pa.string())
    ids = lambda c: pc.fill_null(pc.index_in(c, value_set=known), -1).to_numpy(zero_copy_only=False)
    h = np.zeros(rows, _HEAD)
    name = pc.fill_null(col("read_id"), "*")
    letters, lens = _ascii(pc.if_else(pc.equal(pc.binary_length(name), 0), "*", name))
    _check((lens < 255) & ~col("flag").is_null().to_numpy(zero_copy_only=False))
    cigar = col("cigar")
    n_ops = pc.fill_null(pc.list_value_length(cigar), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cigar.flatten()
    op, length = (pc.struct_field(flat, i) for i in (0, 1))
    _check((n_ops < 1 << 16).all() and not op.null_count and not length.null_count)
    op, length = op.to_numpy(zero_copy_only=False).astype(np.int64), length.to_numpy(zero_copy_only=False).astype(np.int64)
    _check((op >= 0) & (op < 16) & (length >= 0) & (length < 1 << 28))
    seq, n = _ascii(col("seq"))
    qual, n_qual = _ascii(col("qual"))
    low, top = -(2**31), 2**31 - 1
    h["tid"], h["pos"], h["name"], h["mapq"], h["ops"] = ids(col("chr")), _ints(col("pos0"), -1, low, top), lens + 1, _ints(col("mapq"), 0, 0, 255), n_ops
    h["flag"], h["n"], h["mate_pos"], h["tlen"] = _ints(col("flag"), 0, 0, 65_535), n, _ints(col("pnext"), -1, low, top), _ints(col("tlen"), 0, low, top)
    h["mate"] = ids(pc.if_else(pc.equal(col("rnext"), "="), col("chr"), col("rnext")))
    half = (n + 1) // 2
    tags = []  # (rows that have it, three letters, its bytes, its length)
    for tag, kind, c in TAGS:
        there = ~col(c).is_null().to_numpy(zero_copy_only=False)
        if kind == "Z":
            text, n_text = _ascii(col(c))
            tags.append((there, tag + kind, text, n_text, n_text + 1))
        else:
            values = _ints(col(c), 0, low, top)
            there = there & (values != -1) if c == "nm" else there
            each = np.where(there, 4, 0)
            tags.append((there, tag + kind, values[there].astype("<i4").view(np.uint8), each, each))
    there, values, each = _bits_of_moves(col("moves"), col("stride"))
    tags.append((there, "mvB", values, each, each))
    size = 32 + lens + 1 + 4 * n_ops + half + n + sum(np.where(t, 3 + space, 0) for t, _, _, _, space in tags)
    ends = _ends(size + before)
    out, at = np.zeros(ends[-1], np.uint8), ends[:-1].astype(np.int64)
    if before:
        out[at[:, None] + np.arange(4)] = size.astype("<i4").view(np.uint8).reshape(-1, 4)
        at += 4
    out[at[:, None] + np.arange(32)] = h.view(np.uint8).reshape(rows, 32)
    at += 32
    out[_places(at, lens)] = letters
    at += lens + 1
    out[_places(at, 4 * n_ops)] = (length << 4 | op).astype("<u4").view(np.uint8)
    at += 4 * n_ops
    codes = np.zeros(2 * int(half.sum()), np.uint8)
    codes[_places(2 * (np.cumsum(half) - half), n)] = _NIBBLE[seq]
    out[_places(at, half)] = codes[::2] << 4 | codes[1::2]
    at += half
    fits = (n_qual == n) & (n > 0)
    out[_places(at, np.where(fits, 0, n))] = 255
    out[_places(at, np.where(fits, n, 0))] = qual[_places(np.cumsum(n_qual) - n_qual, np.where(fits, n, 0))] - np.uint8(33)
    at += n
    for there, letters, values, each, space in tags:
        own = at[there]
        out[own[:, None] + np.arange(3)] = np.frombuffer(letters.encode(), np.uint8)
        out[_places(at + 3, each)] = values
        at += np.where(there, 3 + space, 0)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _bits_of_moves(moves: pa.Array, stride: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a move table, and the arrays of their tags: kind, number, stride, and 0 or 1 for each stride."""
    there = ~(moves.is_null().to_numpy(zero_copy_only=False) | stride.is_null().to_numpy(zero_copy_only=False))
    step = _ints(stride, 0, -128, 127)
    lens = pc.fill_null(pc.list_value_length(moves), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = moves.flatten()
    _check(not values.null_count)
    values, row = values.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lens)), lens)
    _check((values >= 0).all() and ((np.diff(values) >= 0) | (np.diff(row) > 0)).all())
    n, last = np.zeros(len(lens), np.int64), np.cumsum(lens) - 1
    n[lens > 0] = values[last[lens > 0]]
    each = np.where(there, 6 + n, 0)
    at = np.cumsum(each) - each
    out = np.zeros(int(each.sum()), np.uint8)
    own = at[there]
    out[own] = ord("c")
    out[own[:, None] + np.arange(1, 5)] = (n[there] + 1).astype("<i4").view(np.uint8).reshape(-1, 4)
    out[own + 5] = step[there].astype(np.int8).view(np.uint8)
    ones = there[row] & (values < n[row])
    out[at[row[ones]] + 6 + values[ones]] = 1
    return there, out, each


def with_lengths(records: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """framed() of records that have their lengths."""
    buf, at, size = bytes_of(records)
    first = int(at[0]) if len(at) else 0
    return buf[first : first + int(size.sum())].tobytes(), at - first + 4, size - 4


def framed(records: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Records with their lengths before them: all bytes, each record's place behind its length, and that length."""
    buf, at, size = bytes_of(records)
    ends = np.cumsum(size + 4)
    starts = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[(starts - 4)[:, None] + np.arange(4)] = size.astype("<i4").view(np.uint8).reshape(-1, 4)
    out[_places(starts, size)] = buf[_places(at, size)]
    return out.tobytes(), starts, size
