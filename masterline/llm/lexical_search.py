"""Ranked lexical search: a quadtree of impact maxima over each term-document grid.

Documents are read into chunks. A chunk is a grid with a row for each of its terms, the
frequent ones first, and a column for each document; a cell that holds an occurrence has the impact
of the term on the document. The grid is cut into four by four squares, level by level. Of
every square that is not empty the index keeps which of its sixteen parts are not empty and its highest
impact, written as the difference to that of the square around it.

A query descends from the whole grid to single documents. Its state is a range of documents with, for
each query term, the square that the term's row crosses there; the sum of
weights times maxima bounds the score of every document in the range. Ranges
with the highest bounds are opened first, in batches, and one whose bound is below the worst of the
best documents so far is never opened. A range of one document has its exact score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.llm.common import small_batches, store
from masterline.llm.packing import pack, pack_ranks, unpack, unpack_ranks, unzip_bytes, zip_bytes

RESULTS = 20
#: Columns of a grid at most, and about so many characters; words counted at once.
DOCS, CHARS, WORDS = 4096, 8 << 20, 1 << 18
#: Ranges opened at once.
FRONT = 48
#: Query terms sent to the tasks at once.
QUERY_TERMS = 200_000

#: Digits, letters and every byte of a character beyond ASCII are kept, A-Z in lower case; others separate.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class Index(NamedTuple):
    """grids: one row per chunk; lexicon: term, df; documents with a term, and all their terms."""

    grids: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


class _Chunk:
    """Occurrences of terms in documents, counted as words come in."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.counted, self.chars = 0, 0
        self.keys, self.n = [], []

    def add(self, doc_id, text: str | None) -> None:
        words = terms_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.words += words
        self.chars += len(text or "")
        if len(self.words) >= WORDS:
            self._count()

    def _count(self) -> None:
        if self.words:
            codes, found = pd.factorize(np.array(self.words, object))
            known = self.vocabulary
            rows = np.array([known.setdefault(w, len(known)) for w in found.tolist()], np.int64)
            columns = np.repeat(np.arange(self.counted, len(self.ids)), self.lengths[self.counted :])
            keys, n = np.unique(rows[codes] << 12 | columns, return_counts=True)
            self.keys.append(keys)
            self.n.append(n)
        self.words, self.counted = [], len(self.ids)

    def row(self) -> dict:
        self._count()
        keys = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        n = np.concatenate([*self.n, np.zeros(0, np.int64)])
        old = keys >> 12
        dfs = np.bincount(old, minlength=len(self.vocabulary))
        frequent = np.argsort(-dfs, kind="stable")
        place = np.empty(len(frequent), np.int64)
        place[frequent] = np.arange(len(frequent))
        order = np.argsort(place[old] << 12 | keys & 4095)
        words = list(self.vocabulary)
        columns = (keys & 4095)[order].astype("<u2")
        return {
            "doc_ids": self.ids,
            "lengths": pack(self.lengths),
            "terms": zip_bytes(b" ".join([words[i] for i in frequent.tolist()]), 3),
            "dfs": pack_ranks(dfs[frequent]),
            "columns": pack(np.diff(columns, prepend=np.zeros(1, "<u2")), "<u2"),
            "tfs": pack_ranks(n[order]),
            "n_docs": sum(map(bool, self.lengths)),
            "n_terms": sum(self.lengths),
        }


def _chunks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                chunk.add(doc_id, text.as_py())
                if len(chunk.ids) == DOCS or chunk.chars >= CHARS:
                    yield pa.RecordBatch.from_pylist([chunk.row()], schema)
                    chunk = _Chunk()
        if chunk.ids:
            yield pa.RecordBatch.from_pylist([chunk.row()], schema)

    return run


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unzip_bytes(row["terms"]).split(), pa.binary()), pa.array(unpack_ranks(row["dfs"]).astype(np.int64))], ["term", "df"])


def impacts(tfs: np.ndarray, lengths: list[int], columns: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 12 * m), with m = 75 + (25 * length * n_docs) div n_terms."""
    m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths], np.int64)
    tfs = tfs.astype(np.int64)
    return 10**9 * tfs // (1000 * tfs + 12 * m[columns])


def quadtree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From the whole square, with a side of 4**height, down to cells: which of a square's sixteen
    parts (four times the row digit, plus the column digit) are there, and its maximum."""
    code = np.zeros(len(rows), np.int64)
    for level in range(height):
        code |= ((rows >> 2 * level & 3) << 2 | columns >> 2 * level & 3) << 4 * level
    order = np.argsort(code)
    code, best = code[order], values[order]
    parts, maxima = [], [best]
    for _ in range(height):
        first = np.flatnonzero(np.concatenate([[True], code[1:] >> 4 != code[:-1] >> 4]))
        parts.insert(0, np.bitwise_or.reduceat(1 << (code & 15), first).astype("<u2"))
        best = np.maximum.reduceat(best, first)
        maxima.insert(0, best)
        code = code[first] >> 4
    return parts, maxima


def _grids(n_docs: int, n_terms: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dfs, lengths = unpack_ranks(row["dfs"]), unpack(row["lengths"]).tolist()
                if not len(dfs):
                    continue
                columns = np.cumsum(unpack(row["columns"], "<u2"), dtype="<u2").astype(np.int64)
                values = impacts(unpack_ranks(row["tfs"]), lengths, columns, n_docs, n_terms)
                height = 1
                while 4**height < max(len(dfs), len(lengths)):
                    height += 1
                parts, maxima = quadtree(np.repeat(np.arange(len(dfs)), dfs), columns, values, height)
                steps = [maxima[0]] + [np.repeat(a, np.bitwise_count(p)) - b for a, p, b in zip(maxima, parts, maxima[1:], strict=False)]
                out = {
                    "doc_ids": row["doc_ids"],
                    "height": height,
                    "terms": row["terms"],
                    "sizes": [len(x) for x in maxima],
                    "parts": pack(np.concatenate(parts), "<u2"),
                    "maxima": pack(np.concatenate(steps)),
                }
                yield pa.RecordBatch.from_pylist([out], schema)

    return run


class Grid:
    """A chunk's quadtree, with the squares of all levels in one numbering."""

    def __init__(self, row: dict, asked: Container[bytes] | None = None) -> None:
        """``asked``: the terms whose rows are looked up (by default all)."""
        self.ids, self.height, sizes = row["doc_ids"], row["height"], np.array(row["sizes"])
        self.place = {term: i for i, term in enumerate(unzip_bytes(row["terms"]).split()) if asked is None or term in asked}
        # A last square without parts and with maximum 0 stands for the empty ones.
        self.parts = np.concatenate([unpack(row["parts"], "<u2"), np.zeros(sizes[-1] + 1, "<u2")])
        held = np.bitwise_count(self.parts)
        self.child = np.cumsum(held, dtype=np.int32)
        self.child -= held
        self.child += 1
        self.empty = len(self.parts) - 1
        # Impacts are below 10**6. Steps give way to maxima, level by level.
        self.maxima = np.append(unpack(row["maxima"]).view(np.int32), np.int32(0))
        ends = np.cumsum(sizes)
        for start, stop, above in zip(ends[:-1], ends[1:], [0, *ends[:-2]], strict=True):
            np.subtract(np.repeat(self.maxima[above:start], held[above:start]), self.maxima[start:stop], out=self.maxima[start:stop])
        ranks = sorted(range(len(self.ids)), key=lambda j: (self.ids[j] is None, self.ids[j] if self.ids[j] is not None else 0))
        self.rank = np.empty(len(ranks), np.int64)
        self.rank[ranks] = np.arange(len(ranks))

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Columns and scores of the k best documents that score ``floor`` or more, ties by the smaller
        id, and how many ranges were opened."""
        digits = rows[None, :] >> 2 * np.arange(self.height)[:, None] & 3
        squares = np.zeros((1, len(rows)), np.int64)
        level, start, bound = np.array([self.height]), np.zeros(1, np.int64), np.array([self.maxima[0] * weights.sum()])
        docs, scores, opened = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        parts_of_four = np.arange(4)
        while len(bound):
            some = np.argpartition(-bound, FRONT - 1)[:FRONT] if len(bound) > FRONT else np.arange(len(bound))
            opened += len(some)
            at, below = squares[some], level[some] - 1
            part = digits[below][:, None, :] * 4 + parts_of_four[None, :, None]
            parts = self.parts[at].astype(np.int32)[:, None, :]
            there = parts >> part & 1 > 0
            child = np.where(there, self.child[at][:, None, :] + np.bitwise_count(parts & (1 << part) - 1), self.empty)
            sums = (self.maxima[child] * weights).sum(axis=2)
            starts = start[some][:, None] + (parts_of_four << 2 * below[:, None])
            good = sums >= floor
            cells = good & (below == 0)[:, None]
            if cells.any():
                docs, scores = np.concatenate([docs, starts[cells]]), np.concatenate([scores, sums[cells]])
                order = np.lexsort((self.rank[docs], -scores))[:k]
                docs, scores = docs[order], scores[order]
                if len(docs) == k:
                    floor = max(floor, int(scores[-1]))
            good &= (below > 0)[:, None]
            left = np.ones(len(bound), bool)
            left[some] = False
            bound = np.concatenate([bound[left], sums[good]])
            squares = np.concatenate([squares[left], child[good]])
            level = np.concatenate([level[left], np.broadcast_to(below[:, None], good.shape)[good]])
            start = np.concatenate([start[left], starts[good]])
            keep = bound >= floor
            if not keep.all():
                bound, squares, level, start = bound[keep], squares[keep], level[keep], start[keep]
        return docs, scores, opened


def _search(queries, k: int, schema: pa.Schema):
    """A task's best documents of each query, over all its grids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        asked = {t for _, terms, _ in queries.value for t in terms}
        for batch in batches:
            for i in range(batch.num_rows):
                grid = Grid(batch.slice(i, 1).to_pylist()[0], asked)
                for item, terms, weights in queries.value:
                    known = [(grid.place[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in grid.place]
                    if not known:
                        continue
                    held = best.setdefault(item, [])
                    floor = held[-1][0] if len(held) == k else 1
                    rows, w = np.array(known, np.int64).T
                    docs, scores, _ = grid.top(rows, w, k, floor)
                    if len(docs):
                        held += [(s, grid.ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                        held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        del held[k:]
        columns = zip(*((item, d, s) for item, held in best.items() for s, d in held), strict=True)
        if arrays := [pa.array(x, f.type) for x, f in zip(columns, schema, strict=False)]:
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _arrow_id(docs: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    kind = docs.schema[id_col].dataType
    return kind.simpleString(), pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of whole texts; ids are integers or strings. A null or empty text has no terms.
    Rows that repeat are documents of their own."""
    name, kind = _arrow_id(docs, id_col)
    packed = ("lengths", "terms", "dfs", "columns", "tfs")
    schema = pa.schema([("doc_ids", pa.list_(kind)), *((c, pa.binary()) for c in packed), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        chunks = store(plain.mapInArrow(_chunks(schema), f"doc_ids array<{name}>, {', '.join(f'{c} binary' for c in packed)}, n_docs long, n_terms long"), 1)
    sums = chunks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in sums)
    lexicon = store(chunks.select("terms", "dfs").mapInArrow(_lexicon, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")))
    schema = pa.schema([("doc_ids", pa.list_(kind)), ("height", pa.int32()), ("terms", pa.binary()), ("sizes", pa.list_(pa.int32())), ("parts", pa.binary()), ("maxima", pa.binary())])
    grids = chunks.mapInArrow(_grids(n_docs, n_terms, schema), f"doc_ids array<{name}>, height int, terms binary, sizes array<int>, parts binary, maxima binary")
    return Index(store(grids, 1), lexicon, n_docs, n_terms)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t, n) for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for t, n in Counter(terms_of(text)).items()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["item", "term", "n"])


def search(index: Index, items: DataFrame, k: int = RESULTS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    A term weighs floor(1000 * ln((2N + 2) / (2df + 1))), times its occurrences in the item; equal
    scores go by rising doc_id, a null one last. Items that repeat are items of their own;
    an item without terms, or without any that a document holds, has no rows.
    """
    spark = items.sparkSession
    numbered = store(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("item")))
    weight = F.floor(1000 * F.log(F.lit(2 * index.n_docs + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    asked = numbered.select("item", "text").mapInArrow(_counted, "item long, term binary, n long")
    weighed = asked.join(index.lexicon, "term").select("item", "term", (weight * F.col("n")).alias("weight")).where("weight > 0")
    queries = store(weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("weight", "term")), asc=False).alias("terms")))
    kind = index.grids.schema["doc_ids"].dataType.elementType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    schema = pa.schema([("item", pa.int64()), ("doc_id", arrow), ("score", pa.int64())])
    name = f"item long, doc_id {kind.simpleString()}, score long"
    found = spark.range(0).selectExpr("id AS item", f"CAST(NULL AS {kind.simpleString()}) AS doc_id", "id AS score")
    held, size = [], 0
    rows = queries.toLocalIterator()
    while True:
        row = next(rows, None)
        if held and (row is None or size + len(row["terms"]) > QUERY_TERMS):
            shared = spark.sparkContext.broadcast(held)
            found = found.union(store(index.grids.mapInArrow(_search(shared, k, schema), name)))
            shared.unpersist()
            held, size = [], 0
        if row is None:
            break
        held.append((row["item"], [bytes(t["term"]) for t in row["terms"]], [t["weight"] for t in row["terms"]]))
        size += len(row["terms"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
