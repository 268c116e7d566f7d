"""A reference on shared storage, cut where it is needed: chunks of packed bases, a file each, which tasks map into memory.

No read is joined with the reference, and none is shuffled for it: the kernel cuts each read's bases itself, in time that depends neither on
their place nor on the size of the reference."""

import mmap
import os
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions import sequence as sq
from . import fasta

_LETTERS = np.frombuffer(sq.ALPHABET.encode(), np.uint8)
_CODE = np.full(256, 255, np.uint8)
_CODE[_LETTERS] = np.arange(len(_LETTERS))


def pack(seq: bytes) -> bytes:
    """Two bases a byte behind the number of bases and a mark, or as they are, if there are other letters than the alphabet's."""
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    packed = len(_LETTERS) <= 16 and not (codes == 255).any()
    if packed:
        codes = np.append(codes, np.zeros(len(codes) % 2, np.uint8))
    body = (codes[::2] << 4 | codes[1::2]).tobytes() if packed else seq
    return len(seq).to_bytes(8, "little") + bytes([packed]) + body


def cut(held, start: int, end: int) -> bytes:
    """Bases start to end - 1 of what pack() has made, as far as there are any; reads only their bytes."""
    end = min(end, int.from_bytes(held[:8], "little"))
    if start >= end:
        return b""
    if not held[8]:
        return bytes(held[9 + start : 9 + end])
    raw = np.frombuffer(held[9 + start // 2 : 9 + (end + 1) // 2], np.uint8)
    both = np.stack([raw >> 4, raw & 15], 1).ravel()
    return _LETTERS[both[start % 2 : start % 2 + end - start]].tobytes()


def _file(folder: str, name: str, chunk: int) -> str:
    return os.path.join(folder, f"{quote(name, safe='')}.{chunk}.seq")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bases = 0, 0
        for batch in batches:
            for name, chunk, seq in zip(*(batch.column(c).to_pylist() for c in ("chr", "chunk", "seq")), strict=True):
                target, draft = _file(folder, name, chunk), os.path.join(folder, f".{TaskContext.get().taskAttemptId()}.tmp")
                with open(draft, "wb") as f:
                    f.write(pack(seq.encode("latin-1", "replace")))
                os.replace(draft, target)  # a task that runs again writes the same file
                names, bases = names + 1, bases + len(seq)
        yield pa.RecordBatch.from_pydict({"chunks": [names], "bases": [bases]})

    return run


def write(chunks: DataFrame, folder: str, size: int = fasta.CHUNK) -> tuple[int, int]:
    """fasta.read_chunks(), or chr, chunk, seq by chunks of `size` bases -> a new folder on storage that the executors mount; the number of
    chunks and bases."""
    os.makedirs(folder)
    n, bases = (sum(x) for x in zip(*((r.chunks, r.bases) for r in chunks.select("chr", "chunk", "seq").mapInArrow(_writer(folder), "chunks long, bases long").collect()), strict=True)) if chunks.rdd.getNumPartitions() else (0, 0)
    with open(os.path.join(folder, "size"), "w") as f:  # at the end: without it the folder is no store
        f.write(str(size))
    return n, bases


class Store:
    """Opened by a task; maps at most `most` chunks at once."""

    def __init__(self, folder: str, most: int = 64):
        with open(os.path.join(folder, "size")) as f:
            self.size = int(f.read())
        self.folder, self.most, self.maps = folder, most, OrderedDict()

    def _map(self, name: str, chunk: int):
        key = name, chunk
        if key not in self.maps:
            try:
                with open(_file(self.folder, name, chunk), "rb") as f:
                    self.maps[key] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            except FileNotFoundError:
                self.maps[key] = None
            if len(self.maps) > self.most:
                _, old = self.maps.popitem(last=False)
                if old is not None:
                    old.close()
        self.maps.move_to_end(key)
        return self.maps[key]

    def cut(self, name: str | None, start: int | None, end: int | None) -> str:
        """The reference over [start, end), as far as there is any; nothing of an unknown chromosome."""
        if name is None or start is None or end is None or start < 0:
            return ""
        out = []
        for chunk in range(start // self.size, (end - 1) // self.size + 1 if end > start else 0):
            held = self._map(name, chunk)
            if held is None:
                break
            at = chunk * self.size
            out.append(cut(held, max(start - at, 0), min(end - at, self.size)))
        return b"".join(out).decode("latin-1")
