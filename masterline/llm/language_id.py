"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams in order of
frequency. A text is profiled the same way, and the distance to a language sums,
over the text's n-grams, how far each is out of place; one that the profile lacks
counts as out of place by the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
#: Labelled documents that a language's profile is counted on, about so many at most.
TRAIN_DOCS = 4_000
MOST_LANGUAGES = 1_000
UNKNOWN = "und"


class Profiles(NamedTuple):
    """``ranks[g, l]``: the place of the n-gram ``grams[g]`` (sorted) in language l."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text's lower-cased words and their counts.

    A word is a run of letters with a blank on either side; grams don't cross
    words. A gram packs its code points in 21 bits each.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.concatenate([[32], np.where(letters[points], points, 32), [32]]).astype(np.int64)
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    points, blank = points[keep], blank[keep]
    pairs = (points[:-1] << 21) | points[1:]
    triples = (pairs[:-1] << 21) | points[2:]
    return np.unique(np.concatenate([points[~blank], pairs, triples[~blank[1:-1]]]), return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent, ties in order of the gram."""
    return grams[np.lexsort((grams, -counts))[:k]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(gram_counts(text, letters))
        for lang, found in by_lang.items():
            grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, k: int = PROFILE) -> Profiles:
    """Profiles from the rows with a language, about ``train_docs`` of each at most
    (chosen by a hash of the id). No labelled rows give no languages."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["count"]))])
    sample = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))
    counted = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = summed.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).collect()
    languages = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(grams), len(languages)), -1, np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, grams, ranks)


def distances(top: np.ndarray, grams: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Out-of-place distance of ranked grams to each language, 0 to 1."""
    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
    place = np.where((grams[at] == top)[:, None], ranks[at], -1)
    out = np.where(place < 0, k, np.abs(place - np.arange(len(top))[:, None]))
    return out.sum(axis=0) / (k * len(top))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", k: int = PROFILE, name: str = "language") -> DataFrame:
    """Adds a column ``name`` (lang_pred, score), replacing one so named.

    The nearest language (ties: the first by name), or ``und`` with score 0 where
    the text is null or has no letter, or no language was learned. The score is
    1 less the distance.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(profiles))

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, grams, ranks = shared.value
        letters = letter_table()
        for texts in batches:
            found = []
            for text in texts:
                own = gram_counts(text, letters) if text and languages else ([], [])
                if len(own[0]) < 2:  # a pair of blanks is all that a text without letters has
                    found.append((UNKNOWN, 0.0))
                    continue
                far = distances(top_grams(*own, k), grams, ranks, k)
                best = int(np.argmin(far))
                found.append((languages[best], float(1 - min(far[best], 1.0))))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(name, nearest.asNondeterministic()(F.col(text_col)))
