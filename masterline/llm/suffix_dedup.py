"""Removal of long byte strings that an earlier document holds, by suffix sorting.

Which suffixes can share a prefix of the wanted length is settled by content before
anything is sorted: every window of that length is filed under its minimizer, the
substring of 20 bytes in it with the smallest hash. Equal windows have equal
minimizers, so a window whose minimizer occurs in one document only (Bloom filters of
once- and twice-seen hashes tell) can't repeat. Neighbouring windows under one
minimizer form a piece; a chunk of documents sends each distinct piece once, with its
smallest document, to the part that its minimizer's hash names.

A part sorts the suffixes of its pieces with the difference cover {1, 2} modulo 3:
sampled triples of words are sorted and named, the names' triples are sorted in turn
until they cover the wanted length, the remaining suffixes are merged in by their
first bytes and the rank that follows, and neighbours in that order are compared over
the wanted length. Equal neighbours form groups, whose smallest document goes back
to the chunks and there settles each occurrence.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.llm.common import fresh, n_partitions, small_batches, store, with_number
from masterline.llm.common import pieces as text_pieces
from masterline.llm.packing import blocks, gather, pack, unpack, unzip_bytes, zip_bytes
from masterline.llm.repeats import filter_bits, repeat_filter, suspected

LENGTH = 50
#: Bytes of a minimizer and of a word of the sampled triples.
ANCHOR, WORD = 20, 6
PIECE = 1 << 20
#: Bytes of text and distinct pieces of a chunk, about.
CHUNK_BYTES, CHUNK_PIECES = 1 << 25, 1 << 17
SORT_BYTES = 1 << 19
MULTIPLIER = 0x9FB21C651E98DF25


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each place on."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    part, width, at = data.astype(np.uint64) + np.uint64(1), 1, 0
    while True:
        if ANCHOR & width:
            out = out * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + part[at : at + n]
            at += width
        if at == ANCHOR:
            break
        part = part[:-width] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + part[width:]
        width *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimizer hash of each piece of ``data``."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = anchor_hashes(data)
    # The place in the low bits makes the least key the leftmost of equal hashes.
    low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span = length - ANCHOR + 1
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    return first, last, hashes[place[first]]


def doc_pieces(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``pieces``, for stretches of a text that share no window, with their offset."""
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        yield at, *pieces(np.frombuffer(data[at : at + PIECE + length - 1], np.uint8), length)


def _anchors(length: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in text_pieces([batch]):
            for text in part.column("text").to_pylist():
                found = [h for _, _, _, h in doc_pieces(text, length)]
                yield np.unique(np.concatenate(found))

    return run


SCHEMA = pa.schema(
    {c: pa.int64() if c in ("chunk", "part") else pa.binary() for c in ("chunk", "docs", "marks", "counts", "starts", "numbers", "order", "part", "texts", "sizes", "anchors", "ids")}
)


def _chunks(shared, length: int, n_parts: int, chunk_bytes: int, chunk_pieces: int):
    def rows(chunk: int, docs: list, index: dict[bytes, int], anchors: array, ids: array) -> Iterator[pa.RecordBatch]:
        anchors, ids = np.frombuffer(anchors, np.uint64), np.frombuffer(ids, np.int64)
        parts = (anchors % np.uint64(n_parts)).astype(np.uint32)
        order = np.argsort(parts, kind="stable")
        empty = dict.fromkeys(SCHEMA.names)
        counts = [sum(map(len, d[2])) for d in docs]
        starts = np.concatenate([x for d in docs for x in d[2]] or [np.empty(0, np.int64)])
        numbers = np.concatenate([x for d in docs for x in d[3]] or [np.empty(0, np.int64)])
        out = [
            empty
            | {"chunk": chunk, "docs": pack([d[0] for d in docs], "<i8"), "marks": b"".join(d[1] for d in docs)}
            | {"counts": pack(counts), "starts": pack(starts, "<i8"), "numbers": pack(numbers), "order": pack(order)}
        ]
        texts = list(index)
        for own in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            mine = [texts[i] for i in own]
            out.append(
                empty
                | {"chunk": chunk, "part": int(parts[own[0]]), "texts": zip_bytes(b"".join(mine), 6), "sizes": pack([len(t) for t in mine], "<u2")}
                | {"anchors": pack(anchors[own] >> np.uint64(48), "<u2"), "ids": pack(ids[own], "<i8")}
            )
        yield pa.RecordBatch.from_pylist(out, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, docs, index, anchors, ids = TaskContext.get().partitionId() << 32, 0, [], {}, array("Q"), array("q")
        for batch in text_pieces(batches):
            for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                if index and (size + len(text) > chunk_bytes or len(index) >= chunk_pieces):
                    yield from rows(chunk, docs, index, anchors, ids)
                    chunk, size, docs, index, anchors, ids = chunk + 1, 0, [], {}, array("Q"), array("q")
                size += len(text)
                starts, numbers = [], []
                for at, first, last, hashes in doc_pieces(text, length):
                    own = suspected(shared.value, hashes)
                    if not own.any():
                        continue
                    first, last = first[own] + at, last[own] + at
                    found = np.empty(len(first), np.int64)
                    for k, (a, b, anchor) in enumerate(zip(first.tolist(), (last + length).tolist(), hashes[own].tolist(), strict=True)):
                        number = index.setdefault(text[a:b], len(ids))
                        if number == len(ids):
                            anchors.append(anchor)
                            ids.append(doc_id)
                        elif doc_id < ids[number]:
                            ids[number] = doc_id
                        found[k] = number
                    starts.append(first)
                    numbers.append(found)
                if starts:
                    docs.append((doc_id, mark, starts, numbers))
        if index:
            yield from rows(chunk, docs, index, anchors, ids)

    return run


def _named(new: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names from 1 on by place, in sorted ``order``, where ``new`` says that a row differs from the one before."""
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return names


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys (the first counts most) and each row's name, equal for equal rows.

    Three keys of 21 bits are one number, which sorts far faster than three keys do."""
    if all(not len(k) or k.max() < 1 << 21 for k in keys):
        one = keys[0].astype(np.int64)
        for key in keys[1:]:
            one = one << 21 | key.astype(np.int64)
        keys = (one,)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, _named(new, order)


def _words(data: np.ndarray) -> np.ndarray:
    """The word of WORD bytes from each place on, and from some beyond the end (0)."""
    padded = np.concatenate([data, np.zeros(8 * WORD, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data) + 6 * WORD, np.uint64)
    for k in range(WORD):
        words <<= np.uint64(8)
        words |= padded[k : k + len(words)]
    return words


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` in order of their first ``depth`` bytes at least (0 beyond the end)."""
    n = len(data)
    # A word's rank among all words stands for it in the triples.
    _, words = _dense(_words(data))
    sample = np.flatnonzero(np.arange(n) % 3 != 0)
    ranks = np.zeros(n + 3 * depth + 6 * WORD, np.int64)
    order, ranks[sample] = _dense(words[sample], words[sample + WORD], words[sample + 2 * WORD])
    covered = 3 * WORD
    while covered < depth and len(sample) and ranks[sample].max() < len(sample):
        order, ranks[sample] = _dense(*(ranks[sample + k * covered] for k in range(3)))
        covered *= 3
    sample = sample[order]
    rest = np.arange(0, n, 3)
    byte = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    next_byte = byte[1:]
    wide = np.int64(1) << 40

    def after_one(i: np.ndarray) -> np.ndarray:
        return byte[i] * wide + ranks[i + 1]

    def after_two(i: np.ndarray) -> np.ndarray:
        return (byte[i] << 8 | next_byte[i]) * wide + ranks[i + 2]

    rest = rest[np.argsort(after_one(rest))]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(np.sort(after_one(one)), after_one(rest)) + np.searchsorted(np.sort(after_two(two)), after_two(rest))
    # Ties beyond the depth may disagree between the two kinds of key.
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    out = np.empty(n, np.int64)
    mine = np.zeros(n, bool)
    mine[place] = True
    out[place], out[~mine] = rest, sample
    return out


def least_ids(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the texts, one after another, the smallest id of a text that has it; and
    where each text's windows begin."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    order = suffix_order(data, length)
    order = order[ends[owner[order]] - order >= length]
    same = np.ones(max(0, len(order) - 1), bool)
    words = _words(data)
    for k in [*range(0, length - WORD, WORD), length - WORD]:
        word = words[order + k]
        same &= word[1:] == word[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(ids[owner[order]], starts)
    by_place = np.empty(len(data), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    windows = sizes - length + 1
    return gather(by_place, ends - sizes, windows), np.cumsum(windows) - windows


def _runs(least: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest id: how many in each text, from which window of the
    text on, and the id."""
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[begins] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(begins, first, "right") - 1
    return np.bincount(text, minlength=len(begins)), first - begins[text], least[first]


def _sort(length: int, sort_bytes: int):
    schema = pa.schema({"of": pa.int64(), "part": pa.int64(), "n_runs": pa.binary(), "from": pa.binary(), "ids": pa.binary(), "sizes": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        ids, anchors, sent = array("q"), array("H"), []
        for batch in batches:
            for i in range(batch.num_rows):
                row, own = batch.slice(i, 1).to_pylist()[0], array("I")
                data, end = unzip_bytes(row["texts"]), 0
                for size, anchor, doc_id in zip(unpack(row["sizes"], "<u2").tolist(), unpack(row["anchors"], "<u2").tolist(), unpack(row["ids"], "<i8").tolist(), strict=True):
                    text = data[end : end + size]
                    end += size
                    k = index.setdefault(text, len(ids))
                    if k == len(ids):
                        ids.append(doc_id)
                        anchors.append(anchor)
                    elif doc_id < ids[k]:
                        ids[k] = doc_id
                    own.append(k)
                sent.append((row["chunk"], row["part"], np.frombuffer(own, np.uint32), row["sizes"]))
        if not ids:
            return
        texts, all_ids, anchors = list(index), np.frombuffer(ids, np.int64), np.frombuffer(anchors, np.uint16)
        index.clear()
        # Pieces under one minimizer are sorted together, several minimizers at once. Two
        # bytes of a hash stand for it: minimizers that share them are only sorted together, too.
        order = np.argsort(anchors, kind="stable")
        keys = anchors[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.array([len(t) for t in texts])[order]
        totals = np.add.reduceat(sizes, edges)
        stops = np.append(edges[1:], len(order))
        n_runs, first, least = np.empty(len(texts), np.int64), [], []
        for group in blocks(totals, sort_bytes):
            mine = order[edges[group.start] : stops[group.stop - 1]]
            n_runs[mine], a, b = _runs(*least_ids([texts[k] for k in mine.tolist()], all_ids[mine], length))
            first.append(a.astype(np.uint16))
            least.append(b)
        first, least = np.concatenate(first), np.concatenate(least)
        at = np.empty(len(texts), np.int64)
        at[order] = np.cumsum(n_runs[order]) - n_runs[order]
        for chunk, part, own, sizes in sent:
            n = n_runs[own]
            columns = {"of": [chunk], "part": [part], "n_runs": [pack(n, "<u2")], "sizes": [sizes]}
            columns |= {"from": [pack(gather(first, at[own], n), "<u2")], "ids": [pack(gather(least, at[own], n), "<i8")]}
            yield pa.RecordBatch.from_pydict(columns, schema)

    return run


def _settle(length: int):
    """Spans of a chunk's documents that earlier documents hold."""

    def run(chunk: pa.Table, parts: pa.Table) -> pa.Table:
        ids_out, marks_out, spans_out = [], [], []
        for row in chunk.to_pylist():
            answers = parts.sort_by("part").to_pylist()
            order = unpack(row["order"]).astype(np.int64)
            n_runs = np.empty(len(order), np.int64)
            n_runs[order] = counts = np.concatenate([unpack(a["n_runs"], "<u2") for a in answers]).astype(np.int64)
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(counts) - counts
            first = np.concatenate([unpack(a["from"], "<u2") for a in answers]).astype(np.int64)
            least = np.concatenate([unpack(a["ids"], "<i8") for a in answers])
            windows = np.append(first[1:], 0)
            windows[np.cumsum(counts) - 1] = -1  # a piece's last run ends where the piece does
            starts, numbers = unpack(row["starts"], "<i8"), unpack(row["numbers"]).astype(np.int64)
            docs, per_doc = unpack(row["docs"], "<i8"), unpack(row["counts"]).astype(np.int64)
            sizes = np.empty(len(order), np.int64)
            sizes[order] = np.concatenate([unpack(a["sizes"], "<u2") for a in answers]).astype(np.int64)
            own = numbers
            n = n_runs[own]
            first_run, stop_run, id_run = (gather(x, at[own], n) for x in (first, windows, least))
            doc = np.repeat(np.repeat(np.arange(len(docs)), per_doc), n)
            start = np.repeat(starts, n)
            last = np.where(stop_run < 0, np.repeat(sizes[own], n) - length + 1, stop_run)
            hit = id_run < docs[doc]
            doc, low, high = doc[hit], (start + first_run)[hit], (start + last - 1)[hit] + length
            edges = np.searchsorted(doc, np.arange(len(docs) + 1))
            for d in np.flatnonzero(np.diff(edges)).tolist():
                a, b = low[edges[d] : edges[d + 1]], high[edges[d] : edges[d + 1]]
                by = np.argsort(a, kind="stable")
                a, b = a[by], np.maximum.accumulate(b[by])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                stop = b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
                ids_out.append(docs[d])
                marks_out.append(row["marks"][16 * d : 16 * d + 16])
                spans_out.append(pack(np.column_stack([a[new], stop]).ravel(), "<i8"))
        return pa.table({"of": pa.array(ids_out, pa.int64()), "of_mark": pa.array(marks_out, pa.binary()), "spans": pa.array(spans_out, pa.binary())})

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are shuffled once more, to meet their spans: packed harder than a shuffle does."""
    for batch in text_pieces(batches):
        texts = pa.array([zip_bytes(t, 3) for t in batch.column("text").to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_pieces(batches):
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = unpack(packed, "<i8").reshape(-1, 2).tolist() if packed else []
            text, out, at = unzip_bytes(text), [], 0
            for a, b in spans:
                out.append(text[at:a])
                at = b
            kept.append(b"".join(out) + text[at:])
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept[-1]))
            n_spans.append(len(spans))
        columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) for each row.

    Removes every byte of a text's UTF-8 covered by a string of ``length`` bytes (from
    20 to 1,000) that also starts in a document with a smaller id, as the input stands;
    a maximal removed run is a span. A null text is empty. Rows with equal ids don't
    count as earlier than one another; ids are of any type that sorts, and a null id is
    larger than all others. What is kept may end within a character.
    """
    spark = docs.sparkSession
    if not ANCHOR <= length <= 1000:
        raise ValueError(f"length must be from {ANCHOR} to 1000")
    n = n_partitions(spark)
    text, key = F.coalesce(F.col(text_col), F.lit("")), fresh("__key", docs)
    rows = with_number(docs, id_col, key).select(F.col(id_col).alias("doc_id"), F.col(key).alias("key"), F.unhex(F.md5(text)).alias("mark"), text.cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(2 * size // (length - ANCHOR + 2))
    long_enough = rows.where(F.octet_length("text") >= length)
    with small_batches(spark):
        shared = spark.sparkContext.broadcast(repeat_filter(long_enough.select("text"), bits, _anchors(length)))
    schema = ", ".join(f"{c} {'long' if c in ('chunk', 'part') else 'binary'}" for c in SCHEMA.names)
    named = long_enough.select(F.col("key").alias("doc_id"), "mark", "text")
    with small_batches(spark):
        cut = store(named.mapInArrow(_chunks(shared, length, n, CHUNK_BYTES, CHUNK_PIECES), schema))
    shared.unpersist()
    sent = cut.where("part IS NOT NULL").select("chunk", "part", "texts", "sizes", "anchors", "ids").repartition(n, "part")
    answers = sent.mapInArrow(_sort(length, SORT_BYTES), "of long, part long, n_runs binary, from binary, ids binary, sizes binary")
    chunks = cut.where("docs IS NOT NULL").select("chunk", "docs", "marks", "counts", "starts", "numbers", "order")
    spans = chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_settle(length), "of long, of_mark binary, spans binary")
    spans = spans.dropDuplicates(["of", "of_mark"])
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = rows.mapInArrow(_packed_texts, f"doc_id {id_type}, key long, mark binary, text binary")
    joined = texts.join(spans, (F.col("key") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
