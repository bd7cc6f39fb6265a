"""Numbers and pieces of bytes packed into binary columns, and ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def zip_bytes(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(numbers, kind: str = "<u4") -> bytes:
    """Numbers as compressed planes of bytes, the low bytes of all of them first."""
    flat = np.ascontiguousarray(np.asarray(numbers, kind))
    return zip_bytes(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(unzip_bytes(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_ranks(numbers) -> bytes:
    """Numbers of which most are small, as of words numbered by frequency: those from
    255 on stand in a list of their own."""
    flat = np.asarray(numbers, "<u4")
    small = np.minimum(flat, 255).astype(np.uint8)
    head = zip_bytes(small.tobytes())
    return len(head).to_bytes(8, "little") + head + pack(flat[small == 255] - np.uint32(255))


def unpack_ranks(data: bytes) -> np.ndarray:
    stop = 8 + int.from_bytes(data[:8], "little")
    out = np.frombuffer(unzip_bytes(data[8:stop]), np.uint8).astype("<u4")
    out[out == 255] += unpack(data[stop:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[s : s + n] one after another."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


def blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` in all, at least one row each."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes from one buffer; ``ends`` in bytes, without the leading 0."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
