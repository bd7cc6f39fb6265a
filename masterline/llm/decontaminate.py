"""Benchmark items that occur, exactly or with few edits, anywhere in a document.

A document offers a window of the item's size wherever as many of the item's 8-byte
seeds lie in place, give or take the edits, as must be left when a tenth of its bytes
are edited. Windows and items are embedded by
random walks (CGK: an edit distance becomes a Hamming distance); a window that
agrees with the item in all sampled places of one of many repetitions is a
candidate, and candidates are settled by an exact edit distance between the item
and any part of the text around the window. Letters are compared without ASCII
case, and each white-space character equals a blank.

The items go to the tasks in blocks of bounded size, one pass over the documents
for each block; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.llm.common import pieces as text_pieces

SEED = 8
#: Items of fewer bytes are found where they stand exactly.
SHORTEST = 24
#: Edits by the item's bytes: the most that is reported, and those that are sure to leave
#: enough seeds for a window to be tried.
RATIO, TRIED = 0.15, 0.1
WALKS, REPEATS, SAMPLES = 6, 40, 4
#: Bytes of text searched at once, of items sent to a task at once (their index takes some
#: forty times as much), and of windows embedded at once.
PIECE, ITEM_BLOCK, LAID_OUT = 1 << 20, 1 << 22, 1 << 21
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)


def seed_keys(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, mixed to a 64-bit key."""
    if len(data) < SEED:
        return np.empty(0, np.uint64)
    eight = data.astype(np.uint64)
    for n in (1, 2, 4):
        eight = eight[:-n] | (eight[n:] << np.uint64(8 * n))
    mixed = eight * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def votes_needed(size: int) -> int:
    """Seeds of an item that are left intact whatever a tenth of its bytes are edited to; 1 at least."""
    return max(1, size + 1 - SEED - SEED * int(TRIED * size))


def embed(strings: np.ndarray, walk: np.ndarray) -> np.ndarray:
    """CGK embeddings of rows of bytes that end in a 0: at each step the byte under the
    walk's head, which moves on or stays as the step's random bit for that byte says. The head
    stays on a 0, so it never leaves its row. The result has a row per step."""
    flat = strings.ravel()
    at = np.arange(len(strings), dtype=np.int64) * strings.shape[1]
    out, move = np.empty((len(walk), len(strings)), np.uint8), np.empty(len(strings), np.int64)
    for byte, step in zip(out, walk, strict=True):
        flat.take(at, out=byte, mode="clip")
        step.astype(np.int64).take(byte, out=move, mode="clip")
        at += move
    return out


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edits between the item and any part of the text, and where that part ends (bit-parallel)."""
    found = text.find(item)
    if found >= 0:
        return 0, found + len(item)
    places: dict[int, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, edits, best, end = mask, 0, len(item), len(item), 0
    for j, c in enumerate(text, 1):
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (mask & ~(across | up)), up & across
        if plus & top:
            edits += 1
        elif minus & top:
            edits -= 1
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up, down = minus | (mask & ~(vertical | plus)), plus & vertical
        if edits < best:
            best, end = edits, j
    return best, end


def laid_out(strings: list[bytes], longest: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(longest + 1, b"\0") for s in strings), np.uint8).reshape(-1, longest + 1)


def sampled(strings: np.ndarray, walk: np.ndarray, samples: np.ndarray, longest: int) -> np.ndarray:
    """Each row's embedding at its own sampled steps."""
    return np.take_along_axis(embed(strings, walk[: 2 * longest]), samples.T, axis=0).T


class Items:
    """A block of items with the index of their seeds and their sampled embeddings."""

    def __init__(self, texts: list[bytes], ratio: float) -> None:
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts])
        self.votes = np.array([votes_needed(n) for n in self.sizes.tolist()])
        self.slack = np.floor(self.sizes * ratio).astype(np.int64) + 1
        keys = [seed_keys(np.frombuffer(t, np.uint8)) for t in texts]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(k) for k in keys])
        offset = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.keys, count = np.unique(keys[order], return_counts=True)
        self.count = count.astype(np.int32)
        self.first = np.cumsum(count) - count
        self.bits = min(27, max(16, int(len(self.keys) * 16).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.keys >> np.uint64(64 - self.bits)] = True
        # A walk of its own seed begins alike however long it is: blocks make no difference.
        self.walks = [np.random.default_rng([10, k]).integers(0, 2, (2 * int(self.sizes.max()), 256), dtype=np.int8) for k in range(WALKS)]
        for walk in self.walks:
            walk[:, 0] = 0  # the padding holds the head
        shares = [np.random.default_rng([11, k]).random(REPEATS * SAMPLES) for k in range(WALKS)]
        self.samples = [np.floor(share[None, :] * 2 * self.sizes[:, None]).astype(np.int64) for share in shares]
        # Items of about one size are laid out together: no window is padded to the longest item.
        self.kind = np.ceil(np.log2(self.sizes)).astype(int)
        self.longest = {int(k): int(self.sizes[self.kind == k].max()) for k in np.unique(self.kind)}
        self.marks = [np.empty(s.shape, np.uint8) for s in self.samples]
        for kind, longest in self.longest.items():
            own = np.flatnonzero(self.kind == kind)
            strings = laid_out([texts[i] for i in own.tolist()], longest)
            for walk, samples, marks in zip(self.walks, self.samples, self.marks, strict=True):
                marks[own] = sampled(strings, walk, samples[own], longest)

    def alike(self, items: np.ndarray, runs: np.ndarray, windows: list[bytes]) -> set[int]:
        """The runs with a window that agrees with its item in all samples of any repetition.
        A run found by one walk takes no part in the next."""
        found: set[int] = set()
        for kind, longest in self.longest.items():
            of_kind = np.flatnonzero(self.kind[items] == kind)
            at_once = max(1, LAID_OUT // longest)
            for start in range(0, len(of_kind), at_once):
                some = of_kind[start : start + at_once]
                own, run = items[some], runs[some]
                strings = laid_out([windows[k] for k in some.tolist()], longest)
                for walk, samples, marks in zip(self.walks, self.samples, self.marks, strict=True):
                    same = sampled(strings, walk, samples[own], longest) == marks[own]
                    same = same.reshape(len(own), REPEATS, SAMPLES).all(axis=2).any(axis=1)
                    if same.any():
                        found.update(run[same].tolist())
                        left = ~np.isin(run, run[same])
                        own, run, strings = own[left], run[left], strings[left]
                    if not len(own):
                        break
        return found

    def seeds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and the place at which it would start, for each of its seeds in the data."""
        keys = seed_keys(data)
        at = np.flatnonzero(self.table[keys >> np.uint64(64 - self.bits)])
        slot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        real = self.keys[slot] == keys[at]
        at, slot = at[real], slot[real]
        n = self.count[slot]
        posting = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.owner[posting], np.repeat(at, n) - self.offset[posting]

    def search(self, docs: list[bytes], ratio: float) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, end) for the documents of one piece."""
        starts = np.cumsum([0, *(len(d) + SEED for d in docs)])
        data = b"".join(d + b"\0" * SEED for d in docs)
        item, start = self.seeds(np.frombuffer(data, np.uint8))
        if not len(item):
            return
        doc = np.clip(np.searchsorted(starts, start + self.sizes[item] // 2, "right") - 1, 0, len(docs) - 1)
        order = np.lexsort((start, doc, item))
        item, doc, start = item[order], doc[order], start[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > self.slack[item[1:]])
        run = np.cumsum(new) - 1
        votes = np.bincount(run)
        keep = votes[run] >= self.votes[item]
        item, doc, start, run = item[keep], doc[keep], start[keep], run[keep]
        once = np.ones(len(item), bool)
        once[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1])
        item, doc, start, run = item[once], doc[once], start[once], run[once]
        if not len(item):
            return
        windows = [data[max(0, s) : max(0, s) + self.sizes[i]] for s, i in zip(start.tolist(), item.tolist(), strict=True)]
        near = self.alike(item, run, windows)
        edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if int(run[a]) not in near:
                continue
            i, d = int(item[a]), int(doc[a])
            low = max(0, int(start[a] - starts[d] - self.slack[i]))
            high = int(start[b - 1] - starts[d] + self.sizes[i] + self.slack[i])
            edits, end = best_match(self.texts[i], docs[d][low:high])
            if edits <= ratio * self.sizes[i]:
                yield d, i, edits, low + end


def find_exactly(texts: list[bytes], docs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, 0, end) of the first place of each of some short items in each document."""
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(texts):
        automaton.add_word(t.decode("latin-1"), i)  # one character for each byte
    automaton.make_automaton()
    for d, data in enumerate(docs):
        found: dict[int, int] = {}
        for end, i in automaton.iter(data.decode("latin-1")):
            found.setdefault(i, end + 1)
        for i, end in found.items():
            yield d, i, 0, end


def _search(shared, ratio: float, overlap: int, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        long = [k for k, t in enumerate(texts) if len(t) >= SHORTEST]
        brief: dict[bytes, list[int]] = {}  # equal short items are one word of the automaton
        for k, t in enumerate(texts):
            if len(t) < SHORTEST:
                brief.setdefault(t, []).append(k)
        items = Items([texts[k] for k in long], ratio) if long else None

        def pieces(docs) -> Iterator[list[tuple]]:
            held, size = [], 0
            for doc_id, text in docs:
                data = plain(text)
                for at in range(0, max(1, len(data)), PIECE):
                    held.append((doc_id, at, data[at : at + PIECE + overlap]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for batch in text_pieces(batches):
            out = []
            for held in pieces(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data = [d for _, _, d in held]
                if items:
                    out += [(held[d][0], ids[long[i]], edits, held[d][1] + end) for d, i, edits, end in items.search(data, ratio)]
                if brief:
                    words = list(brief)
                    out += [(held[d][0], ids[k], 0, held[d][1] + end) for d, i, _, end in find_exactly(words, data) for k in brief[words[i]]]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, item_type), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["doc_id", "item_id", "edits", "end"])

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int = ITEM_BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Items that aren't empty in blocks of at most ``most_bytes`` (or one item)."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("octet_length(t) > 0").toLocalIterator():
        data = plain(row["t"])
        if texts and size + len(data) > most_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(data)
        size += len(data)
    if texts:
        yield ids, texts


def find_items(docs: DataFrame, items: DataFrame, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits and end (byte offset in the text), once for each pair whose
    edit distance is at most ``ratio`` of the item's bytes.

    The place with the fewest edits (then the first) is reported. Null and empty items
    and texts match nothing; items under 24 bytes are found where a text holds them
    exactly; rows that share an id are one document. Every window with up to 10 % of
    edits is tried (but for items of 30 or 31 bytes), with more if the edits leave seeds
    enough, as changed words do; the samples agree for over 99 % of those with 10 %.
    Edits beyond 10 % that are spread so evenly as to leave fewer seeds are missed.
    """
    spark = docs.sparkSession
    arrow = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    kinds = [arrow.get(type(t), pa.string()) for t in (id_type, item_type)]
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, edits long, end long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = [
        texts.mapInArrow(_search(spark.sparkContext.broadcast(block), ratio, 2 * max(map(len, block[1])), *kinds), schema)
        for block in item_blocks(items, item_id_col, item_text_col)
    ]
    if not found:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("edits", "end")).alias("best")
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.edits", "best.end")
