"""Toxicity scores from a learned lexicon, matched up to one misspelling.

1. The lexicon holds the words, and beginnings of words, that labelled toxic documents
   have far more often than others (smoothed log ratio of document counts), at most
   ``LEXICON`` of them.
2. Every word is run through the product of the lexicon's trie with the Levenshtein
   automaton of one edit. The product is made deterministic as words come by: a state
   is a set of (trie node, edits so far). Short terms must match exactly, and so must
   beginnings (written ``begin*``), whatever follows them.
3. A hit counts with its term's weight and what is around it: inside quotation marks it
   is a quotation, and more hits within ten words make it abuse more likely. A logistic
   model of these window scores gives the document's score.

Defined results: only text and labels of the rows to learn from are used. A null or empty
text has no hits and gets the model's base score. With no labelled row of both classes the
score is the smoothed rate of toxic labels for every text. Rows are scored each by itself,
so equal texts get equal scores; of rows of one id one is learned from, and of several
labels the larger holds; rows without an id are held out; an empty table gives an empty
result. Texts are read whole in one pass, in time linear in their length; a worker holds
one text of a batch after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .staging import plain, ready, staged

# Bounds: rows learned from, terms of the lexicon, and counts a term needs.
FIT_ROWS = 20_000
LEXICON = 2_000
LEAST_DOCUMENTS = 5
LEAST_LOG_RATIO = 2.0
# Terms of at least this length match with one edit.
FUZZY_LENGTH = 5
WINDOW = 10
# Lengths of the beginnings of words that are counted besides whole words.
STEMS = (4, 5, 6)
STATE_MEMO = 100_000
WORD_MEMO = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile(r"[\"“”„«»]")


class FuzzyLexicon:
    """Terms within one edit of a word, by a lazily built automaton."""

    def __init__(self, terms: Mapping[str, float], edits: int = 1):
        self.terms = dict(terms)
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stems: set[int] = set()
        for term in sorted(self.terms):
            node = 0
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][letter]
            if term.endswith("*"):
                self.stems.add(node)
            # A whole word of the same letters goes before the beginning.
            self.ends[node] = term if self.ends[node] is None else min(self.ends[node], term)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, states: Iterable[tuple[int, int]]) -> frozenset:
        """With the letters of terms that the word leaves out."""
        least: dict[int, int] = {}
        todo = sorted(states, key=lambda s: s[1])
        while todo:
            node, used = todo.pop()
            if used >= least.get(node, self.edits + 1):
                continue
            least[node] = used
            if used < self.edits:
                todo += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _number(self, state: frozenset) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [
                (used, self.ends[node]) for node, used in state if self.ends[node] is not None
                and (not used or (len(self.ends[node]) >= FUZZY_LENGTH and not self.ends[node].endswith("*")))
            ]
            used, term = min(ends, default=(0, None))
            self.accepts.append((term, used) if term is not None else None)
        return known

    def _step(self, number: int, letter: str) -> int:
        """Next state, -1 if no term can be reached any more."""
        after: set[tuple[int, int]] = set()
        for node, used in self.states[number]:
            child = self.children[node].get(letter)
            if child is not None:
                after.add((child, used))
            if not used and node in self.stems:
                after.add((node, 0))
            if used < self.edits:
                after.add((node, used + 1))
                after.update((other, used + 1) for other in self.children[node].values())
        result = self._number(self._closed(after)) if after else -1
        self.steps[number][letter] = result
        return result

    def match(self, word: str) -> tuple[str, int] | None:
        """Nearest term within the edits and how many it took; equal ones by name."""
        if len(self.states) > STATE_MEMO:
            self._forget()
        at = self.start
        for letter in word:
            after = self.steps[at].get(letter)
            at = self._step(at, letter) if after is None else after
            if at < 0:
                return None
        return self.accepts[at]


FEATURES = 6


class Scorer:
    """Window scores of a text, and the model's probability."""

    def __init__(self, terms: Mapping[str, float], weights: Iterable[float] = (), base: float = 0.0):
        self.lexicon = FuzzyLexicon(terms)
        self.weights = np.array(list(weights) or [0.0] * FEATURES)
        self.base = base
        self.memo: dict[str, tuple[str, int] | None] = {}

    def __reduce__(self):
        return Scorer, (self.lexicon.terms, self.weights.tolist(), self.base)

    def _match(self, word: str) -> tuple[str, int] | None:
        if word in self.memo:
            return self.memo[word]
        found = self.lexicon.match(word)
        if len(self.memo) < WORD_MEMO:
            self.memo[word] = found
        return found

    def hits(self, text: str) -> list[tuple[int, str, int, bool]]:
        """Hits ``(word number, term, edits, quoted)`` of a lower-case text."""
        found = {w: m for w in set(_WORD.findall(text)) if (m := self._match(w)) is not None}
        if not found:
            return []
        quotes = [q.start() for q in _QUOTE.finditer(text)]
        lines = [n.start() for n in re.finditer("\n", text)] if quotes else []
        out = []
        line = 0  # lines that begin before the word
        before = opened = 0  # quotation marks before the word, before its line
        for number, word in enumerate(_WORD.finditer(text)):
            match = found.get(word.group())
            if match is not None:
                # Between an odd quotation mark of its line and the next one.
                while line < len(lines) and lines[line] < word.start():
                    while opened < len(quotes) and quotes[opened] < lines[line]:
                        opened += 1
                    line += 1
                while before < len(quotes) and quotes[before] < word.start():
                    before += 1
                behind = bool(quotes) and quotes[-1] >= word.end()
                out.append((number, *match, behind and (before - opened) % 2 == 1))
        return out

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        hits = self.hits(text)
        if not hits:
            return [0.0] * FEATURES
        terms, exact, fuzzy, quoted, best = self.lexicon.terms, 0.0, 0.0, 0.0, 0.0
        for place, (number, term, edits, inside) in enumerate(hits):
            weight = terms[term]
            near = sum(
                terms[t] for n, t, e, q in hits[max(0, place - WINDOW):place + WINDOW + 1]
                if abs(n - number) <= WINDOW and not q and not e
            )
            if inside:
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                exact += weight
                best = max(best, near)
        return [
            np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(best),
            float(exact > 0), min(1.0, len(hits) / 20),
        ]

    def score(self, text: str | None) -> float:
        total = self.base + float(np.dot(self.weights, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and weights from rows ``(text, label)``; words are counted once a document."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                whole = set(_WORD.findall((text or "").lower()))
                for word in whole.union(*[{f"{w[:n]}*" for w in whole if len(w) > n} for n in STEMS]):
                    count.setdefault(word, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array([c[0] for c in count.values()], pa.int64()),
                 pa.array([c[1] for c in count.values()], pa.int64())],
                names=["word", "clean", "toxic"],
            )

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    counted = sample.select("text", "label").mapInArrow(words, "word string, clean long, toxic long")
    sums = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = sums.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("weight", ratio)
    chosen = chosen.where(F.col("weight") >= LEAST_LOG_RATIO)
    rows = chosen.orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "word").limit(LEXICON).collect()
    return {r.word: r.weight for r in rows}


def logistic(features: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; six columns and a bounded number of rows."""
    x = np.c_[features, np.ones(len(features))]
    weights = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * features.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - labels) + penalty @ weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty
        change = np.linalg.solve(bend, slope)
        weights -= change
        if np.abs(change).max() < 1e-8:
            break
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Scorer:
    """Scorer from ``docs(id, text)`` and ``labels(id, label)`` of at most ``rows`` documents.

    The documents are those of the smallest hashes of labelled ids; of two labels of one
    id the larger holds. The chosen ids are at most ``rows``, so they are broadcast, and
    no other text leaves its place.
    """
    ready(docs.sparkSession)
    known = labels.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = staged(docs.join(F.broadcast(chosen), "id").dropDuplicates(["id"]), "sample")
    terms = lexicon(sample)
    if not terms:
        counts = sample.agg(F.sum("label").alias("one"), F.count(F.lit(1)).alias("n")).first()
        rate = ((counts.one or 0) + 0.5) / (counts.n + 1)
        return Scorer({}, base=float(np.log(rate / (1 - rate))))
    plain_scorer = Scorer(terms)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([plain_scorer.features(x) for x in texts.to_pylist()], pa.list_(pa.float64()))

    seen = sample.select(features("text").alias("f"), "label").collect()
    weights, base = logistic(np.array([r.f for r in seen]), np.array([r.label for r in seen], dtype=float))
    return Scorer(terms, weights, base)


def score_column(text: Column, scorer: Scorer) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 500):
            out += [scorer.score(x) for x in texts.slice(at, 500).to_pylist()]
        return pa.array(out, pa.float64())

    return score(text)


def score_documents(
    df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """``id, held_out, score, predicted`` of every row, learned from labels not held out."""
    docs = plain(df, id=id, text=text)
    marks = plain(labels, id=id, label=label).where(~held_out(F.col("id")))
    scorer = fit(docs, marks)
    scored = docs.withColumn("score", score_column(F.col("text"), scorer))
    return scored.select(
        F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
