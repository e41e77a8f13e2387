"""Language of a text by rank-order profiles of its n-grams.

A profile lists a language's most frequent n-grams of one to three letters, most
frequent first. A document's own list is compared to each profile: every n-gram adds
the number of places it is out of place, one that the profile lacks adds the most.
The language of the smallest sum is taken, equal sums by name.

Words are runs of letters in lower case; a border counts as a character of two- and
three-letter n-grams. Texts of any length are counted whole.

Defined results: a null text, an empty one and one without letters are ``und`` with
score 0, and so is every text when there is nothing to learn from. A row without id
is held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .staging import plain, ready

UNKNOWN = "und"
# Length of a profile and of a document's list.
RANKS = 300
# Documents whose n-grams are counted together.
COUNTED = 200
# So many different n-grams of a task are handed on together.
HANDED_ON = 1 << 18
# Every fifth document, by the check sum of its id, is never learned from.
FOLDS = 5


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: 21 bits a character, 0 for a border."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.r_[0, np.where(_letters()[codes], codes, 0), 0]
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    one, two = codes[1:], codes[:-1]
    pairs = (two << 21) | one
    triples = (pairs[:-1] << 21) | codes[2:]
    return np.concatenate([one[one != 0], pairs, triples[codes[1:-1] != 0]])


def ranked(text: str, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams of a text, equal counts by code."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Ranks of n-grams by language."""

    def __init__(self, lists: dict[str, list[int]], ranks: int = RANKS):
        self.names = sorted(lists)
        self.grams = np.unique(np.array([g for grams in lists.values() for g in grams], dtype=np.int64))
        self.most = ranks
        self.places = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int32)
        for row, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(lists[name], dtype=np.int64))
            self.places[row, at] = np.arange(len(at))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language."""
        at = np.searchsorted(self.grams, grams)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != grams] = len(self.grams)
        places = self.places[:, at]
        away = np.minimum(np.abs(places - np.arange(len(grams), dtype=np.int32)), self.most)
        return np.where(places < 0, self.most, away).sum(axis=1)

    def judged(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and length of the text's own list."""
        grams = ranked(text or "", self.most)
        if not len(grams) or not len(self.grams):
            return UNKNOWN, 0.0, len(grams)
        away = self.distances(grams)
        best = int(away.argmin())
        return self.names[best], 1.0 - float(away[best]) / (self.most * len(grams)), len(grams)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged(text)[:2]


def fit_rows(labelled: DataFrame) -> DataFrame:
    """The rows ``(id, text, lang)`` that profiles are made of: all that have both."""
    return labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def _added(some: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of n-grams and their counts as one."""
    grams, at = np.unique(np.concatenate([some[0], more[0]]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([some[1], more[1]]))
    return grams, counts


def fit(labelled: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles from all rows ``(id, text, lang)``; at most ``ranks`` n-grams a language reach the driver."""
    ready(labelled.sparkSession)

    def rows_of(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by_lang.items():
                counted = np.unique(np.concatenate(parts), return_counts=True)
                found[lang] = _added(found[lang], counted) if lang in found else counted
            if sum(len(grams) for grams, _ in found.values()) >= HANDED_ON:
                yield from rows_of(found)
                found = {}
        yield from rows_of(found)

    counted = fit_rows(labelled).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ranks)
    lists: dict[str, list[int]] = {}
    for row in sorted(best.select("lang", "gram", "place").collect(), key=lambda r: (r.lang, r.place)):
        lists.setdefault(row.lang, []).append(row.gram)
    return Profiles(lists, ranks)


def predict_column(text: Column, profiles: Profiles) -> Column:
    """``struct<lang_pred, score, n>`` of each text; ``n`` n-grams were ranked."""

    @F.arrow_udf("struct<lang_pred: string, score: double, n: int>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, sizes = [], [], []
        for at in range(0, len(texts), 500):
            for text in texts.slice(at, 500).to_pylist():
                lang, score, size = profiles.judged(text)
                langs.append(lang)
                scores.append(score)
                sizes.append(size)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())],
            names=["lang_pred", "score", "n"],
        )

    return predict(text)


def keep_known(
    docs: DataFrame, profiles: Profiles, least: float, judged: int, least_judged: float, text: str = "text"
) -> DataFrame:
    """Rows whose text is of a learned language and scores ``least`` at least.

    A text of ``judged`` n-grams or more needs ``least_judged``. Rows pass Python as they
    are, batch by batch, so nothing of them is held beside it.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
            kept = []
            for one in batch.column(text):
                lang, score, size = profiles.judged(one.as_py())
                kept.append(lang != UNKNOWN and score >= (least_judged if size >= judged else least))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def lowest_score(labelled: DataFrame, profiles: Profiles, least: int) -> float | None:
    """Lowest score of the rows profiles were fitted on, of those with ``least`` ranked n-grams."""
    found = fit_rows(labelled).select(predict_column(F.col("text"), profiles).alias("found"))
    return found.where(F.col("found.n") >= least).agg(F.min("found.score")).first()[0]


def training_rows(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    rows = plain(df, id=id, text=text, lang=lang)
    return rows.where(~held_out(F.col("id")))


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row, learned from the rows not held out."""
    profiles = fit(training_rows(df, id, text, lang))
    rows = plain(df, id=id, text=text).withColumn("found", predict_column(F.col("text"), profiles))
    return rows.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "found.lang_pred", "found.score")
