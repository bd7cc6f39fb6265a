"""Contiguous shards of nearly equal bytes, with equal texts kept together.

Documents are ordered by a 64-bit hash of their text, so equal texts form one
atomic group. The smallest shard capacity is found by binary search, each
capacity being checked by greedy filling. No job looks at single groups unless
it must: bytes are first summed over 2**16 ranges of the hash, and the search is
done twice on these sums, once with ranges that can't be cut (an upper bound of
the capacity) and once with ranges that can be cut anywhere (a lower bound).
While the two differ, the ranges in which a cut may fall, and only these, are
summed again at a finer grain. At most a few times 2**16 sums reach the driver
in a round, whatever the size of the table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masterline.llm.common import store

SUMS_PER_ROUND = 1 << 16


class Range(NamedTuple):
    """Groups whose hashes lie from ``first`` to ``last``; one group if these are equal."""

    first: int
    last: int
    size: int


def _ends(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def _fill(ends: list[int], capacity: int, whole: list[bool] | None = None) -> list[tuple[int, int]]:
    """Greedy cuts as (range index, bytes before the cut). ``whole``: which
    ranges can't be cut, all of them if None. Stops where nothing fits."""
    cuts, at, total = [], 0, ends[-1]
    while at < total:
        i = bisect_right(ends, at + capacity) - 1
        to = ends[i] if i == len(ends) - 1 or whole is None or whole[i] else at + capacity
        if to <= at:
            break
        cuts.append((i, to))
        at = to
    return cuts


def _smallest(ends: list[int], low: int, n: int, whole: list[bool] | None) -> int:
    high = max(low, ends[-1])
    while low < high:
        mid = (low + high) // 2
        cuts = _fill(ends, mid, whole)
        if len(cuts) <= n and cuts and cuts[-1][1] == ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def bounds(ranges: list[Range], n: int) -> tuple[int, int]:
    """Lower and upper bound of the smallest capacity that ``n`` shards allow."""
    ends, whole = _ends([r.size for r in ranges]), [r.first == r.last for r in ranges]
    low = max([-(-ends[-1] // n), *(r.size for r, w in zip(ranges, whole, strict=True) if w)])
    return _smallest(ends, low, n, whole), _smallest(ends, low, n, None)


def to_refine(ranges: list[Range], n: int, low: int, high: int) -> set[int]:
    """Indices of divisible ranges in which a cut may fall for a capacity from low to high."""
    ends, whole = _ends([r.size for r in ranges]), [r.first == r.last for r in ranges]
    far = _fill(ends, high, whole)
    chosen: set[int] = set()
    at = 0
    for k in range(min(n, len(far))):
        i = bisect_right(ends, at + low) - 1
        at = ends[i]  # the least that shard k can reach
        chosen.update(j for j in range(i, min(far[k][0] + 1, len(ranges))) if not whole[j])
    return chosen


def balanced_cuts(sizes: list[int], n: int, capacity: int) -> list[int]:
    """Ends (exclusive) of ``n`` runs none above ``capacity``, each as near as
    may be to an equal share of what is left."""
    ends, m = _ends(sizes), len(sizes)
    need = [0] * (m + 1)
    for j in range(m - 1, -1, -1):
        need[j] = 1 + need[max(j + 1, bisect_right(ends, ends[j] + capacity) - 1)]
    cuts, j = [], 0
    for left in range(n - 1, -1, -1):
        target = ends[j] + (ends[m] - ends[j]) / (left + 1)
        most = bisect_right(ends, ends[j] + capacity) - 1
        i = bisect_left(ends, target)
        if i > j and i <= m and target - ends[i - 1] <= ends[min(i, m)] - target:
            i -= 1
        i = max(j, min(i, most, m))
        while need[i] > left and i < most:
            i += 1
        cuts.append(i)
        j = i
    return cuts


def capacity_and_ends(groups: DataFrame, n: int) -> tuple[int, list[int]]:
    """The smallest capacity and the last hash of each shard but the final one.

    ``groups`` has columns ``h`` and ``size``; rows with one ``h`` stay together.
    """

    def sums(df: DataFrame, shift: int) -> list[Range]:
        rows = (
            df.groupBy(F.shiftright("h", shift).alias("k"))
            .agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("size"))
            .collect()
        )
        return sorted(Range(r["first"], r["last"], r["size"]) for r in rows)

    shift = 48
    ranges = sums(groups, shift)
    if not ranges:
        return 0, []
    while True:
        low, high = bounds(ranges, n)
        chosen = to_refine(ranges, n, low, high) if low < high else set()
        if not chosen:
            break
        fine = sorted({r.first >> shift for r in map(ranges.__getitem__, chosen) if r.first >> shift == r.last >> shift})
        wide = [r for r in map(ranges.__getitem__, chosen) if r.first >> shift != r.last >> shift]
        inside = " OR ".join(
            [f"shiftright(h, {shift}) IN ({', '.join(f'{k}L' for k in fine)})"] * bool(fine)
            + [f"h BETWEEN {r.first}L AND {r.last}L" for r in wide]
        )
        finer = max(0, shift - max(1, (SUMS_PER_ROUND // len(chosen)).bit_length() - 1))
        kept = [r for j, r in enumerate(ranges) if j not in chosen]
        ranges = sorted(kept + sums(groups.where(inside), finer))
        shift = finer
    cuts = balanced_cuts([r.size for r in ranges], n, high)
    last = [ranges[0].first - 1, *(r.last for r in ranges)]
    return high, [last[c] for c in cuts[:-1]]


def shard(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ``n`` shards by the law ``bytes``.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, h (the group's hash),
    shard and slot (0, 1, ... within the shard, without gaps). Equal texts share a
    shard; a null text counts as the empty text. The largest shard is as small as
    any contiguous cut of the ordered groups allows, so a group larger than a fair
    share is a shard's size by itself; the remaining shards share the rest evenly.
    Rows with equal ids are separate documents with a slot each; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    _, last = capacity_and_ends(rows, n)
    number = " + ".join(["0", *(f"CAST(h > {x}L AS INT)" if x > -(2**63) else "1" for x in last)])
    # Slots: counts of (shard, part) give each part its first slot. Parts depend
    # on the ids alone and hold about 20,000 rows.
    parts = max(64, rows.count() // (n * 20_000))
    dealt = rows.select("*", F.expr(number).alias("shard"), F.expr(f"pmod(xxhash64(doc_id, h), {parts})").alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "h")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(firsts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "h", "shard", (F.col("first") + F.col("place")).alias("slot"))
    )
