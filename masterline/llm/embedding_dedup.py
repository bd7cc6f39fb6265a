"""Near-duplicate vectors: small-world graphs per shard, every shard queried.

Vectors are compared within a label. Equal vectors are one point. The points of a
label are dealt out to shards of bounded size, each with a hierarchical navigable
small-world graph; a point queries its own shard and those with a smaller number, so a
pair of points meets once. A task first audits its graph: for a sample of queries
the links and nearest points found are held against brute force, and the beam is
doubled until the recall is reached; where no beam reaches it, the shard's points are all
compared. Every found pair is settled by its cosine in
double precision. Tasks emit counts and spanning links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.llm.common import components, grouped, n_partitions, store

THRESHOLD = 0.93
#: Points in a shard, and queries that share one building of its graph.
SHARD, QUERIES = 2048, 16384
LINKS, BUILD_BEAM, BEAM = 12, 48, 32
RECALL, AUDIT = 0.99, 48
#: Queries compared with all points of a shard at once.
AT_ONCE = 256


class Graph:
    """A navigable small-world graph over unit vectors, with up to 2 * LINKS links at level 0."""

    def __init__(self, points: np.ndarray, seed: int = 7) -> None:
        self.x = points
        n = len(points)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        self.level[:1] = self.level.max(initial=0)
        self.links = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.level.max(initial=0) + 1)]
        for i in range(1, n):
            self._insert(i)

    def _greedy(self, q: np.ndarray, level: int, at: int) -> int:
        best = self.x[at] @ q
        while True:
            near = self.links[level][at]
            near = near[near >= 0]
            if not len(near):
                return at
            sims = self.x[near] @ q
            k = int(sims.argmax())
            if sims[k] <= best:
                return at
            at, best = int(near[k]), sims[k]

    def _beam(self, q: np.ndarray, level: int, at: int, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Points near q and their similarities: the beam's, and all that a chain of
        points with a similarity of ``reach`` or more leads to."""
        seen = np.zeros(len(self.x), bool)
        seen[at] = True
        ids, sims, done = np.array([at]), np.array([self.x[at] @ q]), np.zeros(1, bool)
        while True:
            least = np.partition(sims, len(sims) - beam)[len(sims) - beam] if len(sims) > beam else -2.0
            front = ~done & (sims >= min(least, reach))
            if not front.any():
                return ids, sims
            done |= front
            near = self.links[level][ids[front]].ravel()
            near = near[near >= 0]
            near = np.unique(near[~seen[near]])
            seen[near] = True
            ids = np.concatenate([ids, near])
            sims = np.concatenate([sims, self.x[near] @ q])
            done = np.concatenate([done, np.zeros(len(near), bool)])

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The nearest ids that are nearer to the point than to one chosen before; then the nearest."""
        order = np.argsort(-sims, kind="stable")[: 3 * most]
        ids, sims = ids[order], sims[order]
        if len(ids) <= most:
            return ids
        between = self.x[ids] @ self.x[ids].T
        chosen, rest = [], []
        closest = np.full(len(ids), -2.0)
        for k in range(len(ids)):
            if sims[k] > closest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(closest, between[k], out=closest)
            else:
                rest.append(k)
        return ids[(chosen + rest)[:most]]

    def _insert(self, i: int) -> None:
        q, at = self.x[i], 0
        for level in range(len(self.links) - 1, -1, -1):
            if level > self.level[i]:
                at = self._greedy(q, level, at)
                continue
            ids, sims = self._beam(q, level, at, BUILD_BEAM, 2.0)
            at = int(ids[sims.argmax()])
            links = self.links[level]
            width = links.shape[1]
            own = self._select(ids, sims, LINKS)
            links[i, : len(own)] = own
            for j in own.tolist():
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    near = np.append(row, i)
                    row[:] = -1
                    kept = self._select(near, self.x[near] @ self.x[j], width)
                    row[: len(kept)] = kept

    def search(self, q: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        at = 0
        for level in range(len(self.links) - 1, 0, -1):
            at = self._greedy(q, level, at)
        return self._beam(q, 0, at, beam, reach)

    def audited_beam(self, queries: np.ndarray, beam: int, threshold: float) -> int:
        """``beam``, doubled until the sampled queries' links and five nearest points are found;
        0 where only all points would do, as in a small shard or a graph that has fallen apart."""
        while beam < len(self.x):
            wanted = found = 0
            for q in queries:
                sims = self.x @ q
                k = min(5, len(sims))
                true = np.union1d(np.flatnonzero(sims >= threshold), np.argpartition(-sims, k - 1)[:k])
                ids, _ = self.search(q, beam, threshold)
                wanted += len(true)
                found += int(np.isin(true, ids).sum())
            if found >= RECALL * wanted:
                return beam
            beam *= 2
        return 0

    def near(self, queries: np.ndarray, beam: int, threshold: float) -> Iterator[np.ndarray]:
        """For each query the points found at the threshold: by the beam or, where that is 0, by the
        product with all points."""
        if beam:
            for q in queries:
                ids, sims = self.search(q, beam, threshold)
                yield ids[sims >= threshold]
            return
        for start in range(0, len(queries), AT_ONCE):
            for sims in queries[start : start + AT_ONCE] @ self.x.T:
                yield np.flatnonzero(sims >= threshold)


def _vectors(table: pa.Table) -> np.ndarray:
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(table.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Links:
    """Counts and a spanning forest of the links found in one task's shard."""

    def __init__(self) -> None:
        self.n: dict[str, int] = {}
        self.up: dict[str, str] = {}

    def root(self, a: str) -> str:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b] if b in up else b
            a = b
        return a

    def add(self, a: str, b: str, a_copies: int, b_copies: int) -> None:
        self.n[a] = self.n.get(a, 0) + b_copies
        self.n[b] = self.n.get(b, 0) + a_copies
        low, high = sorted((self.root(a), self.root(b)))
        self.up[high] = low

    def batch(self) -> pa.RecordBatch:
        nodes = list(self.n)
        columns = [pa.array(nodes, pa.string()), pa.array([self.n[a] for a in nodes], pa.int64()), pa.array([self.root(a) for a in nodes], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "to"])


def _query(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, shard_nodes, copies, beam, place = None, [], [], BEAM, {}
        for part in grouped(batches, "group", "shard", "turn", "kind"):
            nodes, n = part.column("node").to_pylist(), part.column("copies").to_pylist()
            points = _vectors(part)
            if part.column("kind")[0].as_py() == 0:  # a shard, ahead of its queries
                graph, shard_nodes, copies, beam = Graph(points), nodes, n, BEAM
                place = {node: i for i, node in enumerate(nodes)}
                continue
            # A graph that failed an audit is not asked again.
            beam = beam and graph.audited_beam(points[:: max(1, len(points) // AUDIT)], beam, threshold)
            links, own = _Links(), {}
            for found, node, q_copies in zip(graph.near(points, beam, threshold), nodes, n, strict=True):
                for i in found.tolist():
                    if node in place:  # a pair within the shard may be found from both sides
                        k = place[node]
                        if i != k:
                            own[min(i, k), max(i, k)] = None
                    else:
                        links.add(node, shard_nodes[i], q_copies, copies[i])
            for i, k in own:
                links.add(shard_nodes[i], shard_nodes[k], copies[i], copies[k])
            yield links.batch()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join vectors of one label with a cosine of ``threshold`` or more. A null
    label, or a vector that is null, empty, zero, or holds a null or non-finite
    component, links with nothing; so do vectors of different lengths. Equal vectors are
    linked (their cosine is 1). component_id is the smallest id that links reach;
    rows with equal ids are separate vectors of one id, and a null id keeps a null
    component unless links give it one.
    """
    spark = vectors.sparkSession
    n = n_partitions(spark)
    doubles = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & (F.size(doubles) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound & F.exists(doubles, lambda x: x != 0), F.lit(False))
    name = F.md5(F.concat_ws(",", F.col(label_col).cast("string"), F.transform(doubles, lambda x: x.cast("string"))))
    rows = store(
        vectors.select(
            F.col(id_col).alias("vec_id"),
            F.when(sound, name).alias("node"),
            F.concat_ws(" ", F.col(label_col).cast("string"), F.size(doubles)).alias("group"),
            F.when(sound, doubles).alias("x"),
        )
    )
    points = store(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("x").alias("x"))
        .mapInArrow(_packed, "node string, least long, copies long, group string, vector binary")
    )
    sizes = points.groupBy("group").agg(F.count("*").alias("size")).withColumnRenamed("group", "of")
    dealt = points.join(sizes, F.col("group") == F.col("of")).withColumns(
        {"own": F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SHARD)), "turns": F.ceil(F.col("size") / QUERIES)}
    )
    columns = ["group", "shard", "turn", "kind", "node", "copies", "vector"]
    every_turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))
    index = dealt.withColumns({"shard": F.col("own"), "turn": every_turn, "kind": F.lit(0)}).select(columns)
    smaller = F.explode(F.sequence(F.lit(0).cast("long"), F.col("own")))
    # A shard's own points query it in one turn, which sees each of its pairs once.
    turn = F.when(F.col("shard") == F.col("own"), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")))
    queries = dealt.withColumn("shard", smaller).withColumns({"turn": turn, "kind": F.lit(1)}).select(columns)
    tasks = index.union(queries).repartition(n, "group", "shard", "turn").sortWithinPartitions("group", "shard", "turn", "kind", "node")
    links = store(tasks.mapInArrow(_query(threshold), "node string, n long, to string"))
    joined = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    least = joined.join(points.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    found = joined.join(least, "root").select("node", "component_id")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    facts = store(points.select("node", "least", "copies").join(counts, "node", "left").join(found, "node", "left"))
    out = rows.select("vec_id", "node").join(facts, "node", "left")
    out = out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "least", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(v, "<f8").tobytes() for v in batch.column("x").to_pylist()]
        names = ["node", "least", "copies", "group"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.binary())], [*names, "vector"])
