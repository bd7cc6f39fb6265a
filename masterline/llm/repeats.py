"""Bloom filters of hashes that may occur in a table, once or twice.

Every task lists the bits of two filters, of hashes seen once and seen twice, for some
hashes at a time; the lists are merged slice by slice, where a bit on two lists counts
as seen twice. A hash that two rows hold is never missed. The size is fixed beforehand
and bounded, so what reaches the driver and is broadcast does not grow with the table
beyond the bound; a filter too small for its table suspects more, no less. Only the
driver holds a whole filter while it is made.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from masterline.llm.common import n_partitions
from masterline.llm.packing import pack, unpack

SLICE_BITS = 1 << 21
#: Hashes, about, that a task holds at once.
HASHES = 1 << 20
#: Bounds of a filter's size; 2**30 bits are 128 MB, the most that is broadcast.
LEAST_BITS, MOST_BITS = SLICE_BITS, 1 << 30


def filter_bits(hashes: int) -> int:
    """About 16 bits for each of so many expected hashes, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * hashes).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def suspected(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = places(hashes, 8 * len(bitmap))
    return has(bitmap, a) & has(bitmap, b)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _fill(bits: int, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    def slices(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        once, twice = (_distinct(np.concatenate(places(x, bits))) for x in (found, found[n > 1]))
        edges = np.arange(0, bits + 1, SLICE_BITS).astype(np.uint64)
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        own = np.flatnonzero(np.diff(a)).tolist()
        columns = [pa.array([pack(np.diff(x[at[k] : at[k + 1]], prepend=edges[k])) for k in own], pa.binary()) for x, at in ((once, a), (twice, b))]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *columns], ["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                size += len(hashes)
                if size >= HASHES:
                    yield slices(held)
                    held, size = [], 0
        if size:
            yield slices(held)

    return run


def _bits(steps: bytes) -> np.ndarray:
    flags = np.zeros(SLICE_BITS, bool)
    flags[np.cumsum(unpack(steps), dtype=np.int64)] = True
    return np.packbits(flags, bitorder="little")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, k in enumerate(batch.column("slice").to_pylist()):
            once, twice = (_bits(batch.column(c)[i].as_py()) for c in ("once", "twice"))
            if k in slices:
                seen, again = slices[k]
                again |= twice | (seen & once)
                seen |= once
            else:
                slices[k] = (once, twice)
    for k, (seen, again) in slices.items():
        yield pa.RecordBatch.from_pydict({"slice": [k], "once": [zlib.compress(seen, 1)], "twice": [zlib.compress(again, 1)]})


def _bitmap(rows: DataFrame, bits: int, hashes_of: Callable, which: str) -> np.ndarray:
    schema = "slice long, once binary, twice binary"
    filled = rows.mapInArrow(_fill(bits, hashes_of), schema).repartition(n_partitions(rows.sparkSession), "slice")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in filled.mapInArrow(_merge, schema).select("slice", which).toLocalIterator():
        start = row["slice"] * SLICE_BITS // 8
        bitmap[start : start + SLICE_BITS // 8] = np.frombuffer(zlib.decompress(bytes(row[which])), np.uint8)
    return bitmap


def repeat_filter(rows: DataFrame, bits: int, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The bitmap of hashes that may occur twice. ``hashes_of`` gives a batch's
    hashes in arrays, each without repeats that don't count."""
    return _bitmap(rows, bits, hashes_of, "twice")


def seen_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of hashes that may occur in the table's only column, of longs."""

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(np.uint64)

    return _bitmap(hashes, bits, hashes_of, "once")
