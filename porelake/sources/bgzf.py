"""BGZF: gzip members of at most 64 KB whose headers state their size, read and written by virtual offset; and the index of a sorted BAM."""

import struct
import zlib
from typing import BinaryIO

import numpy as np

BLOCK = 65_280
# The empty block that ends a file, and the number of an index's bin of counts.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
COUNTS_BIN = 37_450


class Reader:
    """Bytes of a file from a virtual offset: a block's place in the file, shifted by 16, and a place in its data."""

    def __init__(self, f: BinaryIO, at: int = 0):
        self.f, self.next = f, at >> 16
        self._fill()
        self.i = at & 0xFFFF

    def _fill(self) -> bool:
        self.block, self.i, self.data = self.next, 0, b""
        self.f.seek(self.block)
        head = self.f.read(12)
        if len(head) < 12:
            return False
        extra, size, i = self.f.read(struct.unpack_from("<H", head, 10)[0]), None, 0
        while i + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("not a BGZF file")
        self.data = zlib.decompress(self.f.read(size - 12 - len(extra))[:-8], -15)
        self.next = self.block + size
        return True

    def tell(self) -> int:
        while self.i >= len(self.data) and self._fill():
            pass
        return self.block << 16 | self.i

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end of the file."""
        out = self.data[self.i : self.i + n]
        self.i += len(out)
        if len(out) == n:
            return out
        out = bytearray(out)
        while len(out) < n and self._fill():
            more = self.data[: n - len(out)]
            self.i = len(more)
            out += more
        return bytes(out)


class Writer:
    def __init__(self, f: BinaryIO):
        self.f, self.at, self.data = f, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.data)

    def write(self, b: bytes) -> int:
        """The virtual offset at which b stands. What doesn't fit in this block starts one, and goes through several if need be."""
        if self.data and len(self.data) + len(b) > BLOCK:
            self.flush()
        at = self.tell()
        self.data += b
        while len(self.data) >= BLOCK:
            self.flush()
        return at

    def write_all(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As write() one after the other, of pieces of these sizes: the virtual offsets at which each stands, and those behind each."""
        ends = np.cumsum(sizes)
        at, after, i = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
        while i < len(sizes):
            done, held = int(ends[i] - sizes[i]), len(self.data)
            k = int(np.searchsorted(ends, done + BLOCK - held, "right"))
            if k > i:
                here = self.at << 16 | held
                after[i:k] = here + ends[i:k] - done
                at[i:k] = after[i:k] - sizes[i:k]
                self.data += data[done : ends[k - 1]]
                while len(self.data) >= BLOCK:
                    self.flush()
                after[k - 1] = self.tell()
                i = k
            else:
                at[i] = self.write(data[done : ends[i]])
                after[i] = self.tell()
                i += 1
        return at, after

    def flush(self) -> None:
        part = bytes(self.data[:BLOCK])
        del self.data[:BLOCK]
        if part:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
            self.f.write(struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
            self.at += len(body) + 26

    def close(self) -> None:
        while self.data:
            self.flush()
        self.f.write(EOF)


def header_size(head: bytes) -> int | None:
    """Size of the block that begins with these bytes (18 are enough where the extra field has nothing else); none if it is no block."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    n, i = struct.unpack_from("<H", head, 10)[0], 12
    while i + 6 <= min(12 + n, len(head)):
        if head[i : i + 4] == b"BC\x02\x00":
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + struct.unpack_from("<H", head, i + 2)[0]
    return None


def next_block(f: BinaryIO, at: int, end: int) -> int | None:
    """The first block that begins in [at, end) of the file; none if there is none. Bytes that only look like a block's are told by
    unpacking it, which checks its sum, and by another block, or the end, behind it."""
    size = f.seek(0, 2)
    lo = at
    while lo < end:
        f.seek(lo)
        piece = f.read(1 << 17)
        if not piece:
            return None
        i = piece.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            if lo + i >= end:
                return None
            if _is_block(f, lo + i, size):
                return lo + i
            i = piece.find(b"\x1f\x8b\x08\x04", i + 1)
        lo += max(1, len(piece) - 3)
    return None


def _is_block(f: BinaryIO, at: int, size: int) -> bool:
    f.seek(at)
    n = header_size(head := f.read(256))
    if n is None or at + n > size:
        return False
    f.seek(at)
    whole = f.read(n)
    start = 12 + struct.unpack_from("<H", head, 10)[0]
    try:
        data = zlib.decompress(whole[start:-8], -15)
    except zlib.error:
        return False
    total, length = struct.unpack("<II", whole[-8:])
    return len(data) == length and zlib.crc32(data) == total and (at + n == size or header_size(f.read(256)) is not None)


def bin_of(start: int, end: int, depth: int = 5) -> int:
    """The smallest bin of the index's tree of `depth` levels, the lowest of 16 kb, that holds [start, end)."""
    shift, first = 14, ((1 << 3 * depth) - 1) // 7
    for level in range(depth, 0, -1):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
        shift += 3
        first -= 1 << 3 * (level - 1)
    return 0


def bins_of(start: np.ndarray, end: np.ndarray, depth: int = 5) -> np.ndarray:
    """bin_of() of many."""
    out = np.zeros(len(start), np.int64)
    shift, first = 14 + 3 * (depth - 1), 1
    for level in range(1, depth + 1):
        fits = start >> shift == (end - 1) >> shift
        out[fits] = first + (start[fits] >> shift)
        first += 1 << 3 * level
        shift -= 3
    return out


def bins_over(start: int, end: int, depth: int = 5) -> list[int]:
    """All bins that something over [start, end) may be in."""
    out, shift, first = [0], 14 + 3 * depth, 0
    for level in range(1, depth + 1):
        shift -= 3
        first += 1 << 3 * (level - 1)
        out += range(first + (start >> shift), first + ((end - 1) >> shift) + 1)
    return out


def depth_for(length: int) -> int:
    """Levels that an index of references up to this length needs: 5 up to 512 Mb, which is what the .bai form has."""
    depth = 5
    while length > 1 << (14 + 3 * depth):
        depth += 1
    return depth


class Index:
    """Bins' chunks and 16 kb windows' first offsets, gathered from records in their order; 8 bytes a window, and for a bin a chunk a block at most,
    however its records alternate there with those of other bins."""

    def __init__(self, refs: int, depth: int = 5):
        self.bins, self.windows, self.unplaced, self.depth = [{} for _ in range(refs)], [[] for _ in range(refs)], 0, depth
        self.last = (-1, -1)

    def add_all(self, tid: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, after: np.ndarray) -> None:
        """add() of records one behind the other; those of one bin make one chunk, over blocks as well, and so do a bin's in one block."""
        there = tid >= 0
        self.unplaced += int((~there).sum())
        number = np.where(there, bins_of(start, end, self.depth), -1)
        cuts = np.flatnonzero((np.diff(tid) != 0) | (np.diff(number) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tid)], strict=True):
            if i == j:
                continue
            t, b = int(tid[i]), int(number[i])
            if t >= 0:
                chunks = self.bins[t].setdefault(b, [])
                if chunks and ((t, b) == self.last or chunks[-1][1] >> 16 >= int(at[i]) >> 16):
                    chunks[-1][1] = int(after[j - 1])
                else:
                    chunks.append([int(at[i]), int(after[j - 1])])
            self.last = (t, b) if t >= 0 else (-1, -1)
        tid, start, end, at = tid[there], start[there], end[there], at[there]
        first, n = start >> 14, ((end - 1) >> 14) - (start >> 14) + 1
        own = np.repeat(np.arange(len(n)), n)
        window = first[own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]
        keys, nth = np.unique(tid[own] << 32 | window, return_index=True)
        for key, x in zip(keys.tolist(), at[own[nth]].tolist(), strict=True):
            windows, w = self.windows[key >> 32], key & 0xFFFFFFFF
            windows += [0] * (w + 1 - len(windows))
            windows[w] = windows[w] or x

    def add(self, tid: int, start: int, end: int, at: int, after: int) -> None:
        if tid < 0:
            self.unplaced += 1
            return
        chunks, windows = self.bins[tid].setdefault(bin_of(start, end, self.depth), []), self.windows[tid]
        if chunks and chunks[-1][1] >> 16 >= at >> 16:
            chunks[-1][1] = after
        else:
            chunks.append([at, after])
        windows += [0] * (((end - 1) >> 14) + 1 - len(windows))
        for w in range(start >> 14, ((end - 1) >> 14) + 1):
            windows[w] = windows[w] or at

    def merge(self, chunks: list[tuple[int, int, int, int]], windows: list[tuple[int, int, int]], unplaced: int, shift: int) -> None:
        """Takes in what a later part of the file has gathered, (reference, bin, first, last) and (reference, window, offset) by virtual offsets
        in that part, which begins `shift` bytes into the file."""
        for tid, number, a, b in chunks:
            own = self.bins[tid].setdefault(number, [])
            a, b = a + (shift << 16), b + (shift << 16)
            if own and own[-1][1] >> 16 >= a >> 16:
                own[-1][1] = b
            else:
                own.append([a, b])
        for tid, w, at in windows:
            own = self.windows[tid]
            own += [0] * (w + 1 - len(own))
            own[w] = own[w] or at + (shift << 16)
        self.unplaced += unplaced

    def chunks(self, tid: int, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets, in order, in which all records over [start, end) of a reference begin."""
        if not 0 <= tid < len(self.bins) or start >= end:
            return []
        windows = self.windows[tid]
        least = next((x for x in windows[start >> 14 :] if x), 0) if start >> 14 < len(windows) else 0
        out: list[list[int]] = []
        for a, b in sorted((a, b) for number in bins_over(start, end, self.depth) for a, b in self.bins[tid].get(number, []) if b > least):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def dump(self) -> bytes:
        """The .bai form."""
        out = bytearray(b"BAI\1" + struct.pack("<i", len(self.bins)))
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            out += struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
        return bytes(out + struct.pack("<Q", self.unplaced))

    def dump_csi(self) -> bytes:
        """The .csi form, before it is packed: as many levels as the longest reference needs, and each bin's first offset in place of windows."""
        out = bytearray(b"CSI\1" + struct.pack("<iiii", 14, self.depth, 0, len(self.bins)))
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                first, level = 0, 0
                while number >= first + (1 << 3 * level):
                    first += 1 << 3 * level
                    level += 1
                w = (number - first) << 3 * (self.depth - level)
                least = next((x for x in windows[w:] if x), 0)
                out += struct.pack("<IQi", number, least, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        return bytes(out + struct.pack("<Q", self.unplaced))

    @classmethod
    def load(cls, raw: bytes) -> "Index":
        """Of either form (a .csi unpacked)."""
        csi = raw[:4] == b"CSI\1"
        if not csi and raw[:4] != b"BAI\1":
            raise ValueError("not an index of a BAM file")
        depth, i = (struct.unpack_from("<i", raw, 8)[0], 16 + struct.unpack_from("<i", raw, 12)[0]) if csi else (5, 4)
        if csi and struct.unpack_from("<i", raw, 4)[0] != 14:
            raise ValueError("an index whose lowest bins aren't of 16 kb")
        out = cls(struct.unpack_from("<i", raw, i)[0], depth)
        i += 4
        for tid in range(len(out.bins)):
            n, i = struct.unpack_from("<i", raw, i)[0], i + 4
            for _ in range(n):
                number = struct.unpack_from("<I", raw, i)[0]
                i += 12 if csi else 4
                k = struct.unpack_from("<i", raw, i)[0]
                if csi or number != COUNTS_BIN:
                    ends = struct.unpack_from(f"<{2 * k}Q", raw, i + 4)
                    out.bins[tid][number] = [list(c) for c in zip(ends[::2], ends[1::2], strict=True)]
                i += 4 + 16 * k
            if not csi:
                k = struct.unpack_from("<i", raw, i)[0]
                out.windows[tid] = list(struct.unpack_from(f"<{k}Q", raw, i + 4))
                i += 4 + 8 * k
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which a record starts, in order."""
        found = {c[0] for bins in self.bins for chunks in bins.values() for c in chunks} | {x for windows in self.windows for x in windows}
        return sorted(found - {0})
