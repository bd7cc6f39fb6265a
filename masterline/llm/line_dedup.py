"""Repeated lines, kept only in the document with the smallest id.

Pass 1 fills two Bloom filters, of line keys seen once and seen twice, in every
task, and merges them slice by slice: a bit set in two tasks, or twice in one,
is set in the second filter. Pass 2 emits only keys that the second filter
suspects; these alone are shuffled, with their whole bytes, to confirm exactly
which occur in two documents and to choose the first. A filter never misses a
repeated key, so its size only decides how many suspects prove to be single.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.llm.common import fresh, pieces, store, with_number
from masterline.llm.repeats import filter_bits, repeat_filter, suspected

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """A key for each line: stripped of ASCII blanks, A-Z in lower case."""
    return [line.strip(BLANK) for line in text.lower().split(b"\n")]


def counts_as_key(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode()) >= min_chars)


def _doc_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    return [k for k in dict.fromkeys(line_keys(text or b"")) if counts_as_key(k, min_chars)]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _key_hashes(min_chars: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for piece in pieces([batch]):
            yield _hashes([k for t in piece.column("text").to_pylist() for k in _doc_keys(t, min_chars)])

    return run


def _suspects(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = _doc_keys(text, min_chars)
                own = [own[i] for i in np.flatnonzero(suspected(shared.value, _hashes(own)))]
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _rebuild(text_col: str, drop_col: str, counts: tuple[str, str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(text_col).to_pylist(), batch.column(drop_col).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x, key in zip(lines, line_keys((text or "").encode()), strict=True) if key not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text if not n_dropped[-1] else b"\n".join(lines).decode())
            columns = {c: batch.column(c) for c in batch.schema.names} | {
                text_col: pa.array(kept, pa.string()),
                counts[0]: pa.array(n_lines, pa.int64()),
                counts[1]: pa.array(n_dropped, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    bits: int | None = None,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """Drop from every document the lines whose key is also in one with a smaller id.

    Returns the columns of ``docs`` with the text replaced by its kept lines,
    and the two columns named in ``counts`` (which replace columns so named): lines
    before, and lines dropped. A null text stays null and counts as one empty line;
    keys under ``min_chars`` code points are never dropped, nor are repeats within
    one document. Rows that share an id are one document. Ids are of any type that
    sorts; a null id counts as the largest. ``bits`` sizes a filter; by default some 16 for each line of the
    average length of 64 bytes, within the module's bounds.
    """
    spark = docs.sparkSession
    key, own, drop = (fresh(name, docs) for name in ("__key", "__id", "__drop"))
    marked = with_number(docs, id_col, key)
    plain = marked.select(F.col(key).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        bits = filter_bits(size // 64)
    shared = spark.sparkContext.broadcast(repeat_filter(plain.select("text"), bits, _key_hashes(min_chars)))
    suspects = store(plain.mapInArrow(_suspects(shared, min_chars), "doc_id long, key binary"))
    # Stored, so that the join has an exchange of its own on either side and can
    # split a key that very many documents hold.
    first = store(
        suspects.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("key", "first")
    )
    later = suspects.join(first, "key").where("doc_id > first")
    drops = later.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("key").alias(drop))
    joined = marked.join(drops, F.col(key) == F.col(own), "left").drop(key, own)
    fields = [f for f in docs.schema.fields if f.name not in counts]
    schema = T.StructType([*fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())])
    return joined.mapInArrow(_rebuild(text_col, drop, counts, schema.names), schema)
