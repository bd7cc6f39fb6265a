"""Near-duplicate documents: Jaccard similarity of their word n-grams, by chosen paths.

Documents with the same set of n-grams are one class. A class has a MinHash
signature, a fixed-size stand-in for its set in which two sets agree at a place with
the probability of their similarity. Every run of the join splits the classes
recursively: a bucket picks one or two places of the signature (1 / threshold
on average) and a class goes to the child named by the token at each of them. After
three levels buckets are compared by brute force on short sketches, large ones block
by block, so that every pair of a bucket meets. A bucket so large that this would be
dear is first split for three more levels, in as many runs of its own as give its
pairs the target recall. Runs are repeated until a pair at the threshold is found with
the target recall.

Classes tied together by any run are candidates. Their sets are then compared
exactly, block by block where a group is large, which gives every link between
members of a group, counted by copies.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.llm.common import components, grouped, n_partitions, pieces, store
from masterline.llm.repeats import filter_bits, seen_filter, suspected

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
PLACES = 128
LEVELS = 3
#: Members compared at once; a larger bucket is compared by pairs of blocks of half as many, and one
#: beyond ``LARGE`` is split again first. Sets in a block of a tied group.
BUCKET, LARGE, BLOCK = 512, 1 << 14, 128
#: Places of the sketch (4 bits each) and the least estimated similarity of a candidate,
#: more than four standard deviations below the threshold.
SKETCH, LEAST = 64, 0.58
TOKENS = re.compile(r"\w+")
CACHE = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the n-grams of a text's lower-cased words; a text
    with fewer words has one n-gram of all of them, a text without words none."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        codes = []
        for word in TOKENS.findall((text or "").lower()):
            code = known.get(word)
            if code is None:
                data = word.encode("utf-8", "surrogatepass")
                code = known[word] = zlib.crc32(data) | zlib.adler32(data) << 32
            codes.append(code)
        if not codes:
            return np.empty(0, np.uint64)
        words = _mix(np.array(codes, np.uint64))
        n = min(self.n, len(words))
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = grams * MIX + words[k : len(words) - n + 1 + k]
        return np.unique(_mix(grams + np.uint64(n)))


def signature(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024, None] * factors + terms).min(axis=0))
    return low


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        rng = np.random.default_rng(9)
        factors = rng.integers(0, 1 << 31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        terms = rng.integers(0, 1 << 32, PLACES, dtype=np.uint32)
        for batch in pieces(batches):
            sets, sizes, signs = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingle(text)
                sets.append(hashlib.md5(grams.tobytes()).digest())
                sizes.append(len(grams))
                signs.append(signature(grams, factors, terms).tobytes() if len(grams) else None)
            columns = [batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_id", "n_grams", "sign"])

    return run


def pair_recall(similarity: float, levels: int) -> float:
    """Chance that two sets share a path through so many levels of one run."""
    mean = 1 / THRESHOLD
    lost = 0.0
    for _ in range(levels):
        part = 1 - similarity + similarity * lost
        lost = part * (2 - mean + (mean - 1) * part)
    return 1 - lost


def runs_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - pair_recall(THRESHOLD, LEVELS)))


def paths(signs: np.ndarray, nodes: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) for the buckets that rows reach from the given nodes."""
    rows = np.arange(len(signs))
    second = int((1 / THRESHOLD - 1) * (1 << 32))
    for _ in range(levels):
        pick = _mix(nodes)
        twice = _mix(pick + np.uint64(1)) & np.uint64(0xFFFFFFFF)
        more = np.flatnonzero(twice < second)
        place = np.concatenate([pick % np.uint64(PLACES), (pick[more] >> np.uint64(32)) % np.uint64(PLACES)])
        rows, nodes = np.concatenate([rows, rows[more]]), np.concatenate([nodes, nodes[more]])
        token = signs[rows, place.astype(np.int64)].astype(np.uint64)
        nodes = _mix(nodes * MIX + (place << np.uint64(32) | token))
    return rows, nodes


def _sketches(signs: np.ndarray) -> np.ndarray:
    nibbles = (_mix(signs[:, :SKETCH].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return nibbles[:, ::2] << 4 | nibbles[:, 1::2]


def _paths(n_runs: int, deeper: bool):
    """Buckets of classes at the first level of recursion or, from a large bucket, the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), "<u4").reshape(-1, PLACES)
            sketches = _sketches(signs)
            above = batch.column("bucket").to_numpy().view(np.uint64) if deeper else np.zeros(len(signs), np.uint64)
            for k in range(n_runs):
                rows, nodes = paths(signs, _mix((above + np.uint64(k + 1)) * MIX), LEVELS)
                took = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes.view(np.int64)),
                        batch.column("set_id").take(took),
                        pa.array([x.tobytes() for x in sketches[rows]], pa.binary()),
                    ],
                    ["bucket", "set_id", "sketch"],
                )

    return run


def local_roots(near: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches in a symmetric matrix of links."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root[None, :], len(near)).min(axis=1)
        low = np.minimum(root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties between the members of a bucket whose sketches are close, to the smallest of each knot."""
    out: list[tuple[bytes, bytes]] = []
    for bucket in grouped(batches, "bucket", "i", "j"):
        members = dict(zip(bucket.column("set_id").to_pylist(), bucket.column("sketch").to_pylist(), strict=True))
        if len(members) < 2:
            continue
        ids = sorted(members)
        sketches = np.frombuffer(b"".join(members[i] for i in ids), np.uint8).reshape(len(ids), -1)
        same = np.zeros((len(ids), len(ids)), np.int16)
        for column in sketches.T:
            differ = column[:, None] ^ column[None, :]
            same += ((differ >> 4) == 0).astype(np.int16) + ((differ & 15) == 0)
        root = local_roots((same / SKETCH - 1 / 16) / (15 / 16) >= LEAST)
        out += [(ids[i], ids[r]) for i, r in enumerate(root.tolist()) if r != i]
        if len(out) > 10_000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _met(placed: DataFrame, many: DataFrame) -> DataFrame:
    """Ties within buckets; ``many`` has the sizes ``n`` of those above ``BUCKET``, by ``of``."""
    blocks = F.coalesce(F.ceil(F.col("n") / (BUCKET // 2)), F.lit(1)).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    members = (
        placed.join(many, F.col("bucket") == F.col("of"), "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("set_id", "bucket"), "blocks"))
        .withColumn("other", other)
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "sketch")
    )
    members = members.repartition(n_partitions(placed.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return members.mapInArrow(_compare, "a binary, b binary")


def candidates(classes: DataFrame, n_runs: int) -> DataFrame:
    """Ties (a, b) between classes (set_id, sign) that some run's bucket brings together."""
    schema = "bucket long, set_id binary, sketch binary"

    def sizes(placed: DataFrame) -> DataFrame:
        return store(placed.groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {BUCKET}")).withColumnRenamed("bucket", "of")

    placed = store(classes.mapInArrow(_paths(n_runs, False), schema))
    many = sizes(placed)
    huge = many.where(f"n > {LARGE}").select("of")
    if huge.isEmpty():
        return _met(placed, many).distinct()
    same = F.col("bucket") == F.col("of")
    again = placed.join(huge, same).select("bucket", "set_id").join(classes, "set_id").select("bucket", "set_id", "sign")
    split = store(again.mapInArrow(_paths(n_runs, True), schema))
    return _met(placed.join(huge, same, "left_anti"), many).union(_met(split, sizes(split))).distinct()


def _sets(n: int, shared):
    """The sets of documents that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in pieces(batches):
            wanted = np.flatnonzero(suspected(shared.value, batch.column("hash").to_numpy().view(np.uint64)))
            grams = [shingle(t).tobytes() for t in batch.column("text").take(pa.array(wanted)).to_pylist()]
            sets = [hashlib.md5(g).digest() for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(grams, pa.binary())], ["of", "grams"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as matrix products over shared members."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[place] > 1
    numbers = np.cumsum(counts > 1) - 1
    column, owner = numbers[place[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 8192
    for low in range(0, int(numbers[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    numerator = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, n_out, root_out = [], [], []
        for block in grouped(batches, "root", "i", "j"):
            rows = {r["set_id"]: r for r in block.to_pylist()}
            ids = sorted(rows)
            sets = [np.frombuffer(rows[k]["grams"], np.uint64) for k in ids]
            both = intersections(sets)
            sizes = np.array([len(s) for s in sets], np.float64)
            near = both * 1000 >= numerator * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(near, False)
            part = np.array([rows[k]["block"] for k in ids])
            if block.column("i")[0] != block.column("j")[0]:
                near &= part[:, None] != part[None, :]  # pairs within a block have a group of their own
            copies = np.array([rows[k]["copies"] for k in ids], np.int64)
            n_links, root = near.astype(np.int64) @ copies, local_roots(near)
            for k in np.flatnonzero(n_links).tolist():
                ids_out.append(ids[k])
                n_out.append(int(n_links[k]))
                root_out.append(ids[root[k]])
        yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.binary()), pa.array(n_out, pa.int64()), pa.array(root_out, pa.binary())], ["set_id", "n", "to"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, component_id, kept.

    class_id is the smallest id with the same set of n-grams, n_links the number of
    other documents with a similarity of ``threshold`` or more (copies in the class
    included), component_id the smallest id that links reach, and kept whether that is
    the document's own. Texts without words (null, empty) link with nothing and are
    classes of their own. A pair at the threshold is tied with probability ``recall``
    by its own buckets if its agreement over the 128 places is as expected, and each
    tied group is compared exactly. Rows with equal ids
    are separate documents; a null id is never the smallest unless all are null.
    """
    spark = docs.sparkSession
    n = n_partitions(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = store(texts.mapInArrow(_sign(n_words), f"doc_id {id_type}, set_id binary, n_grams long, sign binary"))
    classes = store(
        signed.where("n_grams > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("sign").alias("sign"))
    )
    ties = candidates(classes.select("set_id", "sign"), runs_for(recall))
    groups = components(ties)
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("root", "of")
    plain = classes.select(F.col("set_id").alias("node"), "class_id", "copies")
    members = store(groups.join(sizes, F.col("root") == F.col("of")).join(plain, "node").select("node", "root", "blocks", "class_id", "copies"))
    # Sets are made again from the texts of the classes' first documents, which a filter
    # of their ids picks without a shuffle; the join below drops what it lets through.
    ids = members.select(F.xxhash64("class_id").alias("hash"))
    shared = spark.sparkContext.broadcast(seen_filter(ids, filter_bits(members.count())))
    sets = texts.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(_sets(n_words, shared), "of binary, grams binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        members.join(sets, F.col("node") == F.col("of"))
        .withColumn("block", block)
        .withColumn("other", other)
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("set_id"), "copies", "grams")
    )
    dealt = dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = store(dealt.mapInArrow(_verify(threshold), "set_id binary, n long, to binary"))
    counts = links.groupBy("set_id").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("set_id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "set_id")
    least = joined.join(classes, "set_id").groupBy("root").agg(F.min("class_id").alias("component_id"))
    facts = store(
        classes.select("set_id", "class_id", "copies")
        .join(counts, "set_id", "left")
        .join(joined.join(least, "root").select("set_id", "component_id"), "set_id", "left")
    )
    rows = signed.select("doc_id", "set_id", "n_grams").join(facts, "set_id", "left")
    alone = F.col("n_grams") == 0
    out = rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "class_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
