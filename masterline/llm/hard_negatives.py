"""Hard negatives for contrastive training, by inner products with coordinate pruning.

Vectors of one label and length class lie in buckets, the longest first. A bucket holds its
vectors sorted along each coordinate. An anchor that still wants scores from some bound
on can meet the bound only with vectors whose coordinates lie in feasible ranges: with the
anchor at an angle a to an axis and the bound an angle t from the anchor, the coordinate on
that axis lies between cos(a + t) and cos(a - t). The ranges of the anchor's largest
coordinates are looked up in the sorted lists and intersected; what is left is scored
exactly in integers. Buckets too short for the bound are skipped whole.

Two passes use this search. The first finds each anchor's positives, the highest scores
within its label. The second finds, for each positive, the highest scores of other labels
in a band below the positive's score. Anchors travel in blocks over lanes of buckets, so that
a task holds one block of anchors with their best scores so far and one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masterline.llm.common import n_partitions, store

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Vectors in a bucket, anchors in a block, anchors scored together.
BUCKET, ANCHORS, TOGETHER = 2048, 8192, 256
#: Coordinates looked up for an anchor, and the share of a bucket from which on all of it is scored.
FOCUS, MOST = 6, 0.5
#: Whole numbers up to this size are exact in doubles.
EXACT = float(1 << 53)

_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1
_ROW = "row long, vec_id long, label string, size int, length double, x binary"
_BUCKET = "bucket long, label string, size int, length double, x binary, ids binary, rows binary, sorted binary"
_TASK = "task long, kind int, turn double, row long, vec_id long, label string, size int, length double, x binary, ids binary, rows binary, sorted binary, wanted array<long>"


def _floored(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.floor(scale * np.array(v, np.float64)) for v in batch.column("x").to_pylist()]
            if any(not np.isfinite(v).all() for v in vectors):
                raise OverflowError(f"a component too large to be multiplied by {scale}")
            columns = [batch.column(c) for c in ("row", "vec_id", "label")]
            sizes = pa.array([len(v) for v in vectors], pa.int32())
            # The length only orders and prunes; scores are exact.
            lengths = pa.array([float(np.sqrt(np.sum((v / s) ** 2)) * s) if (s := np.abs(v).max(initial=0)) else 0.0 for v in vectors], pa.float64())
            x = pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, sizes, lengths, x], ["row", "vec_id", "label", "size", "length", "x"])

    return run


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest form that holds them, named by the first byte."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind[1:].encode() + x.astype(kind).tobytes()


def _unpacked(data: bytes, size: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<" + data[:2].decode(), offset=2).astype(np.float64).reshape(rows, size)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row stays."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    y = x / np.where(most > 0, most, 1)
    lengths = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(lengths > 0, lengths, 1)


def _bucketed(most: int):
    """Buckets from rows sorted by label, size and falling length."""

    def bucket(held: list[dict]) -> dict:
        first, n = held[0], len(held)
        x = np.frombuffer(b"".join(r["x"] for r in held), "<f8").reshape(n, first["size"])
        order = np.argsort(_units(x), axis=0, kind="stable").astype("<u2" if n <= 1 << 16 else "<u4")
        return {
            "bucket": first["row"],
            "label": first["label"],
            "size": first["size"],
            "length": first["length"],
            "x": _packed(x),
            "ids": np.array([r["vec_id"] for r in held], "<i8").tobytes(),
            "rows": np.array([r["row"] for r in held], "<i8").tobytes(),
            "sorted": order.T.tobytes(),
        }

    schema = pa.schema(
        [("bucket", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("length", pa.float64())]
        + [(c, pa.binary()) for c in ("x", "ids", "rows", "sorted")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == most or (r["label"], r["size"]) != (held[0]["label"], held[0]["size"])):
                    yield pa.RecordBatch.from_pylist([bucket(held)], schema)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([bucket(held)], schema)

    return run


class Bucket:
    """Vectors with their ids, in sorted lists by coordinate."""

    def __init__(self, row: dict) -> None:
        self.ids, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        n = len(self.ids)
        self.length, self.x = row["length"], _unpacked(row["x"], row["size"], n)
        self.unit = _units(self.x)
        self.sorted = np.frombuffer(row["sorted"], "<u2" if n <= 1 << 16 else "<u4").reshape(row["size"], n)
        self.most = np.abs(self.x).max(initial=0)

    def feasible(self, unit: np.ndarray, bound: float) -> np.ndarray | None:
        """Places whose coordinates allow a cosine of ``bound`` or more with ``unit``;
        None where the lists leave too many to be worth it."""
        n, angle = len(self.ids), np.arccos(min(1.0, bound))
        best, ranges = None, []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            a = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, a + angle)) - 1e-9, np.cos(max(0.0, a - angle)) + 1e-9
            # The coordinate's values in the list's order; the two ends by bisection.
            values = self.unit[:, f]
            start = np.searchsorted(values, low, "left", sorter=self.sorted[f])
            stop = np.searchsorted(values, high, "right", sorter=self.sorted[f])
            ranges.append((f, low, high))
            if best is None or stop - start < best[1] - best[0]:
                best = (start, stop, f)
        if best is None or best[1] - best[0] > MOST * n:
            return None
        places = self.sorted[best[2]][best[0] : best[1]].astype(np.int64)
        for f, low, high in ranges:
            if f != best[2]:
                values = self.unit[places, f]
                places = places[(values >= low) & (values <= high)]
        return places

    def scores(self, q: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Integer inner products with the vectors at ``places`` (None: all) for each row of q."""
        x = self.x if places is None else self.x[places]
        if self.most * np.abs(q).max(initial=0) * max(1, x.shape[1]) < EXACT:
            return np.rint(q @ x.T).astype(np.int64)
        wide = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
        if wide.size and max(abs(int(v)) for v in wide.ravel()) > _GREATEST:
            raise OverflowError("an inner product beyond 64 bits")
        return np.asarray(wide, np.int64).reshape(len(q), len(x)) if wide.size else np.zeros((len(q), len(x)), np.int64)


class Best:
    """The highest scores in a band, ties by the smaller id."""

    def __init__(self, low: int, high: int, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def bound(self) -> int:
        """The least score that may still enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` rise; those in the band are a slice of them."""
        start, stop = np.searchsorted(scores, self.bound, "left"), np.searchsorted(scores, self.high, "right")
        if stop - start > self.k:  # with all that tie with the last of the k highest
            start = np.searchsorted(scores, scores[stop - self.k], "left")
        if stop <= start:
            return
        s, i, r = (np.concatenate([a, b[start:stop]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, i, -s))[: self.k]
        self.scores, self.ids, self.rows = s[order], i[order], r[order]


class Anchors:
    """A block of anchors and what each has found so far: one band without bounds, or
    one for each positive's score."""

    def __init__(self, rows: list[dict], k: int, low: int, high: int) -> None:
        self.rows, self.same = rows, rows[0]["wanted"] is None
        self.sizes, self.labels = np.array([r["size"] for r in rows]), np.array([r["label"] for r in rows], object)
        self.vectors = [np.frombuffer(r["x"], "<f8") for r in rows]
        self.units = [_units(v[None, :])[0] for v in self.vectors]
        if self.same:
            self.best = [[Best(_LEAST, _GREATEST, k)] for _ in rows]
        else:
            self.best = [[Best(-(-low * p // 100), high * p // 100, k) for p in r["wanted"]] for r in rows]

    def meet(self, row: dict) -> None:
        fits = (self.sizes == row["size"]) & ((self.labels == row["label"]) == self.same)
        bucket, whole = Bucket(row), []
        for a in np.flatnonzero(fits):
            open_bands = [b for b in self.best[a] if b.low <= b.high]
            if not open_bands:
                continue
            bound, reach = min(b.bound for b in open_bands), self.rows[a]["length"] * bucket.length
            if bound <= 0:
                whole.append(a)
            elif bound <= reach * (1 + 1e-9):
                places = bucket.feasible(self.units[a], bound / reach * (1 - 1e-9))
                if places is None:
                    whole.append(a)
                elif len(places):
                    self._offer(a, bucket, bucket.scores(self.vectors[a][None, :], places)[0], places)
        for start in range(0, len(whole), TOGETHER):
            some = whole[start : start + TOGETHER]
            scores = bucket.scores(np.array([self.vectors[a] for a in some]))
            for a, s in zip(some, scores, strict=True):
                self._offer(a, bucket, s, None)

    def _offer(self, a: int, bucket: Bucket, scores: np.ndarray, places: np.ndarray | None) -> None:
        places = np.arange(len(scores)) if places is None else places
        useful = scores >= min(b.bound for b in self.best[a])
        if self.same:
            useful &= bucket.rows[places] != self.rows[a]["row"]
        scores, places = scores[useful], places[useful]
        order = np.argsort(scores, kind="stable")
        scores, places = scores[order], places[order]
        for band in self.best[a]:
            band.offer(scores, bucket.ids[places], bucket.rows[places])

    def batch(self) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for r, bands in zip(self.rows, self.best, strict=True):
            for i, band in enumerate(bands):
                n = len(band.ids)
                for column, values in zip(out, ([r["row"]] * n, [i] * n, band.ids.tolist(), band.rows.tolist(), band.scores.tolist()), strict=True):
                    column += values
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "band", "vec_id", "of", "score"])


def _search(k: int, low: int, high: int):
    """Each task's anchors come first, then its buckets, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, block = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["task"] != task:
                    if block:
                        yield block.batch()
                    task, held, block = row["task"], [], None
                if row["kind"] == 0:
                    held.append(row)
                elif held:
                    block = block or Anchors(held, k, low, high)
                    block.meet(row)
        if block:
            yield block.batch()

    return run


def _met(anchors: DataFrame, buckets: DataFrame, blocks: int, lanes: int, k: int, low: int, high: int) -> DataFrame:
    """row (the anchor's), band, vec_id, of (the other's row), score: the best of every lane."""
    spark = anchors.sparkSession
    none = {c: F.lit(None).cast("binary") for c in ("ids", "rows", "sorted")}
    columns = [c.split()[0] for c in _TASK.split(", ")]
    block, lane = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("bucket"), F.lit(lanes))
    all_lanes, all_blocks = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (lanes, blocks))
    asking = anchors.withColumn("lane", all_lanes).withColumns({"task": block * lanes + F.col("lane"), "kind": F.lit(0), "turn": F.lit(0.0), **none})
    asked = buckets.withColumn("block", all_blocks).withColumns(
        {"task": F.col("block") * lanes + lane, "kind": F.lit(1), "turn": -F.col("length"), "row": F.col("bucket"), "vec_id": F.lit(None).cast("long"), "wanted": F.lit(None).cast("array<long>")}
    )
    tasks = asking.select(columns).union(asked.select(columns)).repartition(n_partitions(spark), "task").sortWithinPartitions("task", "kind", "turn", "row")
    return tasks.mapInArrow(_search(k, low, high), "row long, band int, vec_id long, of long, score long")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x) and a score is the integer inner product. The
    positives of an anchor, a row where ``is_anchor`` holds, are the ``positives`` highest scores
    among the other rows of its label; the negatives of a positive are the ``negatives``
    highest scores of other labels from ``low`` to ``high`` hundredths of the positive's.
    Ties go to the smaller id. Fewer are returned where there are no more.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.
    Rows that repeat are rows of their own: each asks as an anchor, and each may be found.
    Vectors meet only those with as many components; a vector without any scores 0, and as a
    positive of score 0 it finds the negatives of score 0. A negative positive's score
    has an empty band. Scores beyond 64 bits are an error. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    n = n_partitions(spark)
    doubles = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), doubles.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")
    )
    # The row numbers are fixed by the file before rows are dealt out by them.
    numbered = store(part)
    rows = numbered.mapInArrow(_floored(scale), _ROW)
    ranged = rows.repartitionByRange(n, "label", "size", F.desc("length"), "row").sortWithinPartitions("label", "size", F.desc("length"), "row")
    buckets = store(ranged.mapInArrow(_bucketed(BUCKET), _BUCKET))
    anchors = numbered.where("asks").mapInArrow(_floored(scale), _ROW)
    blocks = max(1, -(-numbered.where("asks").count() // ANCHORS))
    lanes = max(1, min(buckets.count(), -(-2 * n // blocks)))
    found = _met(anchors.withColumn("wanted", F.lit(None).cast("array<long>")), buckets, blocks, lanes, positives, low, high)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "of"))
    pairs = store(found.withColumn("place", place).where(F.col("place") <= positives).select("row", (F.col("place") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = pairs.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    asking = anchors.join(wanted, "row")
    found = _met(asking, buckets, blocks, lanes, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id", "of"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = numbered.where("asks").select("row", F.col("vec_id").alias("anchor_id"))
    return (
        best.join(pairs, ["row", "band"])
        .join(named, "row")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
