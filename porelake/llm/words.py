"""Words of many texts at once: spans and hashes in one buffer of bytes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def chunks(texts: pa.Array, rows: int = 128, size: int = 1 << 17) -> Iterator[tuple[int, list[str | None], list[bytes]]]:
    """(first, texts, the same encoded) for ranges of at most `rows` neighbouring texts of about `size` bytes together; a longer text is
    a range of its own. Only so many are held as Python objects, however many the batch has."""
    for a in range(0, len(texts), rows):
        part = texts[a : a + rows].to_pylist()
        coded = [encoded(t) for t in part]
        lo = held = 0
        for i, t in enumerate(coded):
            if i > lo and held + len(t) > size:
                yield a + lo, part[lo:i], coded[lo:i]
                lo, held = i, 0
            held += len(t)
        yield a + lo, part[lo:], coded[lo:]


class Hasher:
    """Hashes of spans of a buffer, by sums of bytes times powers; it holds the powers for buffers of any length met so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            n = max(len(raw) + (len(raw) >> 2), 1 << 18)
            with np.errstate(over="ignore"):
                self.up, self.down = np.cumprod(np.full(n, _STEP | 1, np.uint64)), np.cumprod(np.full(n, pow(_STEP | 1, -1, 2**64), np.uint64))
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[: len(raw)])])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes start .. end - 1; of an empty span 0's."""
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[start]) * self.down[np.minimum(start, len(sums) - 2)] + (end - start).astype(np.uint64))


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with a space behind it, and where each begins (and where the last ends)."""
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), ends


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer: runs of other bytes than white space (0x20, 0x09 to 0x0D)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SEP[raw], [True]]).view(np.int8)))
    return edge[::2], edge[1::2]
