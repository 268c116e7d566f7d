"""VBZ, the packing of raw signals: differences, signs folded into the lowest bit, one or two bytes each, zstd over all."""

import numpy as np
import pyarrow as pa


def pack(signal: np.ndarray) -> bytes:
    """int16 samples -> bytes: a key bit for each sample (set: two bytes, lowest first), eight a byte, then the samples' bytes."""
    x = np.asarray(signal, np.int16)
    d = np.diff(x, prepend=np.int16(0))  # wraps, as the sum does when it is read
    v = ((d << 1) ^ (d >> 15)).astype(np.uint16)
    two = v > 255
    both = np.stack([v & 255, v >> 8], 1).astype(np.uint8)
    body = both[np.stack([np.ones(len(v), bool), two], 1)]
    return pa.compress(np.packbits(two, bitorder="little").tobytes() + body.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, samples: int) -> np.ndarray:
    """What pack() has packed, of so many samples; an error if the bytes hold fewer or more."""
    raw = np.frombuffer(pa.input_stream(pa.py_buffer(packed), compression="zstd").read(), np.uint8)
    keys = (samples + 7) // 8
    if len(raw) < keys:
        raise ValueError("a signal's keys are cut off")
    two = np.unpackbits(raw[:keys], count=samples, bitorder="little")
    body = raw[keys:]
    ends = np.cumsum(two, dtype=np.int64) + np.arange(1, samples + 1)
    if len(body) != (ends[-1] if samples else 0):
        raise ValueError("a signal's bytes don't fit its number of samples")
    at = ends - 1 - two
    v = body[at].astype(np.uint16)
    wide = two.astype(bool)
    v[wide] |= body[at[wide] + 1].astype(np.uint16) << np.uint16(8)
    d = (v >> np.uint16(1)).astype(np.int16) ^ -(v & np.uint16(1)).astype(np.int16)
    return np.cumsum(d, dtype=np.int16)
