"""Quality classifier: a linear-chain CRF labels every line good or bad from its own and its neighbours' features.

A line's features are shares of character classes and measures of repetition, each cut into steps, so that a feature's
effect need not be linear. The line before and the line after add theirs. Lines learn the label of their document;
transitions carry it along. A document's quality is the length-weighted mean of its lines' forward-backward marginals,
put on the scale of probabilities by a logistic fit on the same sample.

The model is fitted on at most ``SAMPLE`` labelled documents (see :mod:`labelled`), scoring covers every whole text.
Defined cases: an empty or null text is one empty line and gets that line's score; without labels of both kinds the
score is the share of label 1 among those seen (1 if none).
"""

from __future__ import annotations

from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.chain import Chain, calibrated, fit, logistic
from pulsegrid.llm.common import with_columns
from pulsegrid.llm.labelled import fitted, remainder, sample

SAMPLE = 4000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
MEASURES = 14
STEPS = 12
#: Steps of a share, finer towards 0 and 1.
EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])


def _classes() -> bytes:
    """Character class of each byte: upper case, letter (with all parts of other scripts), digit, space, stop, mark."""
    out = bytearray(b"m" * 256)
    for b in range(256):
        c = chr(b)
        out[b] = ord("U" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" or b >= 128 else "d" if c.isdigit() else "s" if c in " \t\r\x0b\x0c" else "p" if c in ".,;:'\"?-()" else "m")
    return bytes(out)


CLASSES = _classes()


def line_measures(line: bytes, before: bytes | None, seen: bool) -> list[float]:
    """Shares between 0 and 1 that describe a line; ``seen``: the document has held the same line before."""
    n = max(1, len(line))
    kinds = line.translate(CLASSES)
    upper, lower, digits, space, stops = (kinds.count(k) for k in (b"U", b"l", b"d", b"s", b"p"))
    marks = len(line) - upper - lower - digits - space - stops
    words = line.split()
    w = max(1, len(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        upper / max(1, upper + lower), (upper + lower) / n, digits / n, space / n, stops / n, marks / n,
        1 - len(set(words)) / w, sum(map(eq, words, words[1:])) / w, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        min(1.0, len(line) / w / 20), min(1.0, np.log1p(len(words)) / 8), float(line[-1:] in (b".", b"!", b"?")),
        float(seen), float(line == before),
    ]


def document_lines(text: bytes) -> tuple[list[list[float]], list[int]]:
    """Measures and lengths of a text's lines."""
    measures, lengths, seen, before = [], [], set(), None
    for line in text.split(b"\n"):
        measures.append(line_measures(line, before, line in seen))
        lengths.append(len(line) + 1)
        seen.add(line)
        before = line
    return measures, lengths


def features(measures: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, 3 * MEASURES) feature numbers: own, previous and next line; a missing neighbour is a step of its own."""
    steps = np.searchsorted(EDGES, measures, side="right")
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], STEPS, np.vstack([steps[:1], steps[:-1]]))
    after = np.where(last[:, None], STEPS, np.vstack([steps[1:], steps[-1:]]))
    base = np.arange(MEASURES) * (STEPS + 1)
    whole = MEASURES * (STEPS + 1)
    return np.hstack([steps + base, before + base + whole, after + base + 2 * whole])


SIZE = 3 * MEASURES * (STEPS + 1)


def batch_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths, first marks and document numbers of all lines of ``texts``."""
    measures, lengths, counts = [], [], []
    for x in texts:
        m, n = document_lines(x)
        measures += m
        lengths += n
        counts.append(len(n))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.r_[True, owner[1:] != owner[:-1]]
    return features(np.array(measures), first), np.array(lengths, dtype=float), first, owner


class QualityModel:
    def __init__(self, chain: Chain | None, scale: np.ndarray | None, prior: float) -> None:
        self.chain, self.scale, self.prior = chain, scale, prior

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> QualityModel:
        """Learns from labelled rows outside the held-out fold, at most ``rows`` of them."""
        state = fitted(sample(docs, labels, "quality", remainder("doc_id", FOLDS) != HELD_OUT, rows), lambda found: cls.fit_rows(found).state())
        return cls.of_state(state)

    def state(self) -> tuple:
        """Plain values that make the model up."""
        chain = self.chain and (self.chain.weights, self.chain.transition, self.chain.start)
        return chain, self.scale, self.prior

    @classmethod
    def of_state(cls, state: tuple) -> QualityModel:
        chain, scale, prior = state
        return cls(chain and Chain(*chain), scale, prior)

    @classmethod
    def fit_rows(cls, found: list[tuple[int, bytes, int]]) -> QualityModel:
        y = np.array([r[2] for r in found])
        if len(set(y.tolist())) < 2:
            return cls(None, None, float(y.mean()) if len(y) else 1.0)
        x, lengths, first, owner = batch_lines([r[1] for r in found])
        chain = fit(x, y[owner], first, SIZE)
        model = cls(chain, None, float(y.mean()))
        model.scale = calibrated(model._summary(x, lengths, first, owner, len(found)), y)
        return model

    def _summary(self, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        p = self.chain.marginals(self.chain.scores(x), first)
        mean = np.bincount(owner, weights=p * lengths, minlength=n) / np.bincount(owner, weights=lengths, minlength=n)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.column_stack([mean, np.log(mean / (1 - mean))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.chain is None or not texts:
            return np.full(len(texts), self.prior)
        return logistic(self._summary(*batch_lines(texts), len(texts)), self.scale)

    def lines(self, text: bytes) -> list[float]:
        """Probability of each line to be good."""
        x, _, first, _ = batch_lines([text])
        return self.chain.marginals(self.chain.scores(x), first).tolist()

    def scores(self, docs: DataFrame, name: str = "score", text: str = "text") -> DataFrame:
        """``docs`` with the score as column ``name``."""

        def make() -> Callable[[list[bytes]], list]:
            return lambda texts: [pa.array(self.score(texts))]

        return with_columns(docs, make, [T.StructField(name, T.DoubleType())], column=text)


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    slim = docs.select("doc_id", "text")
    made = QualityModel.fit(slim, labels).scores(slim)
    return made.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
