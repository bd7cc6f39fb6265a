"""Byte-level BPE over a whole corpus, each distinct word being merged once.

Documents are cut into words (the tokenizer's pre-tokens) chunk by chunk. A chunk
keeps, in order of position, the numbers its words have in a dictionary of its
own. The dictionaries' words are dealt out over the corpus by their hash, packed
as one row for each chunk and part; a word costs one entry for each chunk in which
it occurs, however often it does, so no word makes a part much larger than others.
A part encodes each of its distinct words once and sends the ids back to the
chunks, which put them together by position.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.llm.common import n_partitions, pieces, store
from masterline.llm.packing import binary_rows, gather, pack, pack_ranks, unpack, unpack_ranks, unzip_bytes, zip_bytes
from masterline.llm.packing import blocks as blocks_of

#: Characters of text in a chunk; a longer document is a chunk by itself.
CHUNK_CHARS = 1 << 24
#: Words or tokens laid out at once.
BLOCK = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def whole_piece_encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """Merges any string as one piece, for words that are cut already."""
    return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def _chunk_rows(chunk: int, ids: list, counts: list[int], numbers: array, index: dict[str, int], n_parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row with the chunk's documents, and one for each part with its words.

    Words are numbered anew, the most frequent first, as small numbers pack better; those of one
    frequency, most of them, go by part and then by spelling, so that both pack well too.
    """
    found = np.frombuffer(numbers, np.uint32)
    spelled = [w.encode("utf-8", "surrogatepass") for w in index]
    part_of = np.fromiter((zlib.crc32(w) % n_parts for w in spelled), np.uint32, len(spelled))
    order = np.array(sorted(range(len(spelled)), key=spelled.__getitem__), np.int64)
    for key in (part_of, -np.bincount(found, minlength=len(spelled))):
        order = order[np.argsort(key[order], kind="stable")]
    place = np.empty(len(spelled), np.uint32)
    place[order] = np.arange(len(spelled))
    words, parts = [spelled[i] for i in order.tolist()], part_of[order]
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order])) + 1
    empty = dict.fromkeys(schema.names)
    rows = [empty | {"chunk": chunk, "doc_ids": ids, "counts": counts, "packed": pack_ranks(place[found]), "parts": pack(parts)}]
    for own in np.split(order, edges) if len(order) else []:
        mine = [words[i] for i in own]
        sizes = pack([len(w) for w in mine])
        rows.append(empty | {"chunk": chunk, "part": int(parts[own[0]]), "words": zip_bytes(b"".join(mine), 9), "sizes": sizes})
    yield pa.RecordBatch.from_pylist(rows, schema)


def _cut(pattern: str, chunk_chars: int, n_parts: int, id_type: pa.DataType):
    fields = {"doc_ids": pa.list_(id_type), "counts": pa.list_(pa.int32()), "packed": pa.binary(), "parts": pa.binary()}
    schema = pa.schema({"chunk": pa.int64()} | fields | {"part": pa.int32(), "words": pa.binary(), "sizes": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        chunk, chars = TaskContext.get().partitionId() << 32, 0

        def fresh() -> tuple:
            index: defaultdict[str, int] = defaultdict()
            index.default_factory = index.__len__
            return [], [], array("I"), index

        ids, counts, numbers, index = fresh()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and chars + len(text) > chunk_chars:
                    yield from _chunk_rows(chunk, ids, counts, numbers, index, n_parts, schema)
                    chunk, chars = chunk + 1, 0
                    ids, counts, numbers, index = fresh()
                words = find(text)
                numbers.extend(map(index.__getitem__, words))
                ids.append(doc_id)
                counts.append(len(words))
                chars += len(text)
        if ids:
            yield from _chunk_rows(chunk, ids, counts, numbers, index, n_parts, schema)

    return run


def _encode_words(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = whole_piece_encoder(ranks.value).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(unpack(row["sizes"]), dtype=np.int64).tolist()
                data, start, ids = unzip_bytes(row["words"]), 0, []
                for end in ends:
                    word = data[start:end]
                    start = end
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(found)
                columns = {"of": [row["chunk"]], "part": [row["part"]], "ids": [pack(np.frombuffer(b"".join(ids), "<u4"))], "lengths": [pack([len(x) // 4 for x in ids])]}
                yield pa.RecordBatch.from_pydict(columns, pa.schema({"of": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "lengths": pa.binary()}))

    return run


def _assemble(id_type: pa.DataType):
    def run(chunk: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for row in chunk.select(["doc_ids", "counts", "packed", "parts"]).to_pylist():
            found = blocks.sort_by("part").select(["ids", "lengths"]).to_pylist()
            flat = np.concatenate([unpack(r["ids"]) for r in found] or [np.empty(0, "<u4")])
            order = np.argsort(unpack(row["parts"]), kind="stable")
            lengths, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            lengths[order] = np.concatenate([unpack(r["lengths"]) for r in found] or [np.empty(0, np.int64)])
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            counts, words = np.array(row["counts"], np.int64), unpack_ranks(row["packed"])
            ends = np.cumsum(counts)
            for part in blocks_of(counts, BLOCK):
                first = ends[part.start] - counts[part.start]
                own = words[first : ends[part.stop - 1]]
                sums = np.concatenate([[0], np.cumsum(lengths[own])])
                ids = gather(flat, starts[own], lengths[own])
                doc_ids = pa.array(row["doc_ids"][part], id_type)
                out.append(pa.Table.from_arrays([doc_ids, binary_rows(ids, 4 * sums[ends[part] - first])], ["doc_id", "ids"]))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as bytes) of whole texts.

    A null or empty text has no ids. Every match of ``pattern`` is merged by itself;
    special tokens are ordinary text. One row for each row of ``docs``, also where
    ids repeat or are null; other columns are left out.
    """
    spark = docs.sparkSession
    n = n_partitions(spark)
    id_type = docs.schema[id_col].dataType
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunk = f"chunk long, doc_ids array<{id_type.simpleString()}>, counts array<int>, packed binary, parts binary"
    cut = store(plain.mapInArrow(_cut(pattern, chunk_chars, n, arrow_id), f"{chunk}, part int, words binary, sizes binary"))
    words = cut.where("part IS NOT NULL").select("chunk", "part", "words", "sizes").repartition(n, "part")
    blocks = words.mapInArrow(_encode_words(spark.sparkContext.broadcast(ranks)), "of long, part int, ids binary, lengths binary")
    chunks = cut.where("packed IS NOT NULL").select("chunk", "doc_ids", "counts", "packed", "parts")
    return (
        chunks.groupBy("chunk")
        .cogroup(blocks.groupBy("of"))
        .applyInArrow(_assemble(arrow_id), f"doc_id {id_type.simpleString()}, ids binary")
    )


def _decode(token_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, lengths = token_bytes.value
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            for part in blocks_of(sizes, BLOCK):
                some = batch.slice(part.start, part.stop - part.start)
                ids = np.frombuffer(b"".join(x or b"" for x in some.column("ids").to_pylist()), "<u4")
                if len(ids) and ids.max() >= len(lengths) or (lengths[ids] == 0).any():
                    raise ValueError("an id that the token table doesn't hold")
                sums = np.concatenate([[0], np.cumsum(lengths[ids])])
                decoded = binary_rows(gather(flat, starts[ids], lengths[ids]), sums[np.cumsum(sizes[part])])
                yield some.append_column("bytes", decoded)

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``bytes``: the tokens' bytes one after another, looked up in the token table
    (as many rows as the vocabulary). Null ids are none; an unknown id is an error."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    lengths = np.array([len(t) for t in table], np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths))
    schema = T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())])
    return encoded.mapInArrow(_decode(shared), schema)
