"""Toxicity: a linear-chain CRF tags toxic spans in the words of a text.

Labels are known per document, so words get theirs first: a word type counts as toxic if, among texts that differ, it
stands in many different surroundings (previous and next word) in toxic documents and hardly ever in others;
counting surroundings keeps families of near copies from making a word look frequent. Its occurrences in toxic documents
are the labelled tokens. The chain sees the word, its beginning and both neighbours. A document's score is a logistic fit
on what the forward-backward marginals sum to: the chance that any word is toxic and the expected number of toxic words.

The model is fitted on at most ``SAMPLE`` labelled documents; scoring covers every whole text. Words are compared in
lower case without marks at their ends. Defined cases: a text without words gets the score of a text with no toxic
word; without labels of both kinds the score is the share of label 1 among those seen (0 if none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.byte_bpe import memo
from pulsegrid.llm.chain import Chain, calibrated, fit, logistic
from pulsegrid.llm.common import with_columns
from pulsegrid.llm.labelled import fitted, remainder, sample

SAMPLE = 2500
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: A toxic type: at least so many surroundings in toxic documents, so many times what the other documents let expect, and
#: so many standard deviations more.
LEAST_SURROUNDINGS, LEAST_RATIO, LEAST_EXCESS = 6, 4.0, 10.0
#: Buckets of word beginnings; types in fewer documents than this share one number.
BEGINNINGS, LEAST_KNOWN = 8192, 4
#: Documents of each kind that the chain itself is fitted on.
CHAIN_DOCS = 250
KEPT_WORDS = 200_000
#: Documents whose words are held as arrays at once while fitting.
SLICE = 100
_marks = bytes(b for b in range(33, 128) if not chr(b).isalnum())


def plain(word: bytes) -> bytes:
    """A word in lower case (A-Z and other letters) without marks at its ends."""
    word = word.strip(_marks)
    return word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()


class ToxicTagger:
    def __init__(self, chain: Chain | None, scale: np.ndarray | None, known: dict[bytes, int], prior: float, lexicon: list[bytes] | None = None) -> None:
        self.chain, self.scale, self.known, self.prior, self.lexicon = chain, scale, known, prior, lexicon or []
        self.tables: tuple[np.ndarray, ...] | None = None
        self.key = ""

    # ---- learning

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ToxicTagger:
        """Learns from labelled rows outside the held-out fold, at most ``rows`` of them."""
        state = fitted(sample(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, rows), lambda found: cls.fit_rows(found).state())
        return cls.of_state(state)

    def state(self) -> tuple:
        """Plain values that make the tagger up."""
        chain = self.chain and (self.chain.weights, self.chain.transition, self.chain.start)
        return chain, self.scale, self.known, self.prior, self.lexicon

    @classmethod
    def of_state(cls, state: tuple) -> ToxicTagger:
        chain, *rest = state
        model = cls(chain and Chain(*chain), *rest)
        if model.chain:
            model.finish()
        return model

    @classmethod
    def fit_rows(cls, found: list[tuple[int, bytes, int]]) -> ToxicTagger:
        found = list({x: (i, x, y) for i, x, y in found}.values())
        y = np.array([r[2] for r in found])
        if len(set(y.tolist())) < 2:
            return cls(None, None, {}, float(y.mean()) if len(y) else 0.0)
        kept: dict[bytes, bytes] = {}  # each word once in memory
        words = [[kept.setdefault(w, w) for w in map(plain, r[1].split())] for r in found]
        around: tuple[dict[bytes, set], dict[bytes, set]] = ({}, defaultdict(set))
        spread: Counter[bytes] = Counter()
        for kind in (1, 0):  # toxic documents first: of the others only candidates' surroundings are kept
            for own, toxic in zip(words, y.tolist()):
                if toxic == kind:
                    spread.update(set(own))
                    for a, w, b in zip([b"", *own], own, [*own[1:], b""]):
                        if kind or w in around[0]:
                            around[kind][w].add(hash_of(a + b" " + b))
            if kind:
                around[0].update({w: set() for w, s in around[1].items() if w and len(s) >= LEAST_SURROUNDINGS})
        per = y.sum() / max(1, len(y) - y.sum())  # toxic documents for each other one
        lexicon = set()
        for w, others in around[0].items():
            expected, found_in = per * (len(others) + 1), len(around[1][w])
            if found_in >= LEAST_RATIO * expected and found_in - expected >= LEAST_EXCESS * expected**0.5:
                lexicon.add(w)
        known = {w: i + 1 for i, w in enumerate(sorted(w for w, n in spread.items() if n >= LEAST_KNOWN and w))}
        del around, spread
        model = cls(None, None, known, float(y.mean()), sorted(lexicon))
        # the chain itself: toxic and other documents in equal number
        chosen = [i for kind in (0, 1) for i in [j for j in range(len(y)) if y[j] == kind][:CHAIN_DOCS] if words[i]]
        x, first = model.features([words[i] for i in chosen])
        tags = np.array([toxic and w in lexicon for i in chosen for w in words[i] for toxic in (bool(y[i]),)], dtype=np.int64)
        del words, kept
        if len(tags):
            model.chain = fit(x, tags, first, model.size, steps=60, rate=0.3, ridge=1e-8)
            model.finish()
            model.scale = calibrated(np.vstack([model.summary([r[1] for r in found[i : i + SLICE]]) for i in range(0, len(found), SLICE)]), y)
        return model

    @property
    def size(self) -> int:
        return 3 * (len(self.known) + 1) + BEGINNINGS

    def features(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(words, 4) feature numbers (word, beginning, previous, next) and the marks of first words."""
        counts = [len(w) for w in words]
        ids = np.array([self.known.get(w, 0) for own in words for w in own], dtype=np.int64)
        ends = np.array([beginning(w) for own in words for w in own], dtype=np.int64)
        first = np.zeros(len(ids), dtype=bool)
        first[np.r_[0, np.cumsum(counts)[:-1]].astype(int)] = True
        n = len(self.known) + 1
        before = np.where(first, 0, np.r_[0, ids[:-1]])
        after = np.where(np.r_[first[1:], True], 0, np.r_[ids[1:], 0])
        return np.column_stack([ids, n + before, 2 * n + after, 3 * n + ends]), first

    def finish(self) -> None:
        """Weights by part, ready for scoring."""
        n, w = len(self.known) + 1, self.chain.weights
        self.tables = (w[:n], w[n : 2 * n], w[2 * n : 3 * n], w[3 * n :])
        self.key = f"toxic{zlib.crc32(w.tobytes())}-{n}"

    # ---- scoring

    def _rows(self) -> dict[bytes, tuple[int, float]]:
        """Words seen by this worker, as written: number and own weight."""
        return memo(self.key, dict)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, marks of first words and text numbers of all words."""
        seen = self._rows()
        own, _, _, ends = self.tables
        ids: list[int] = []
        lifts: list[float] = []
        counts = []
        for x in texts:
            words = x.split()
            counts.append(len(words))
            rows = list(map(seen.get, words))
            if None in rows:
                for i, row in enumerate(rows):
                    if row is None:
                        w = plain(words[i])
                        at = self.known.get(w, 0)
                        rows[i] = row = (at, float(own[at] + ends[beginning(w)]))
                        if len(seen) < KEPT_WORDS and len(words[i]) <= 40:
                            seen[words[i]] = row
            if rows:
                a, b = zip(*rows)
                ids += a
                lifts += b
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.array(ids, dtype=np.int64)
        score = np.array(lifts)
        first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, dtype=bool)
        if len(owner):
            before = np.where(first, 0, np.r_[0, number[:-1]])
            after = np.where(np.r_[first[1:], True], 0, np.r_[number[1:], 0])
            score = score + self.tables[1][before] + self.tables[2][after]
        return score, first, owner

    def summary(self, texts: list[bytes]) -> np.ndarray:
        score, first, owner = self.tokens(texts)
        p = np.clip(self.chain.marginals(score, first), 0.0, 1 - 1e-9)
        p[p < 0.01] = 0.0  # the floor of thousands of ordinary words must not add up in a long text
        any_one = 1 - np.exp(np.bincount(owner, weights=np.log1p(-p), minlength=len(texts)))
        return np.column_stack([any_one, np.log1p(np.bincount(owner, weights=p, minlength=len(texts)))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.scale is None or not texts:
            return np.full(len(texts), self.prior)
        return logistic(self.summary(texts), self.scale)

    def spans(self, text: bytes, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Byte offsets (start, end) of the tagged words and their marginals; neighbours with one tag form one span."""
        if self.chain is None:
            return []
        score, first, _ = self.tokens([text])
        p = self.chain.marginals(score, first)
        out: list[tuple[int, int, float]] = []
        last = -2
        for i, (m, q) in enumerate(zip(re.finditer(rb"[^\x20\x09-\x0D]+", text), p.tolist())):
            if q >= least:
                if i == last + 1:
                    out[-1] = (out[-1][0], m.end(), max(out[-1][2], q))
                else:
                    out.append((m.start(), m.end(), q))
                last = i
        return out

    def scores(self, docs: DataFrame, name: str = "score", text: str = "text", spans: str | None = None) -> DataFrame:
        """``docs`` with the score as column ``name``; with ``spans`` also the offending spans (start, end, p)."""

        def make() -> Callable[[list[bytes]], list]:
            def work(texts: list[bytes]) -> list:
                score = self.score(texts)
                if not spans:
                    return [pa.array(score)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
                found = [[{"start": a, "end": b, "p": q} for a, b, q in self.spans(x)] if s >= THRESHOLD else [] for x, s in zip(texts, score.tolist())]
                return [pa.array(score), pa.array(found, kind)]

            return work

        fields = [T.StructField(name, T.DoubleType())]
        if spans:
            fields.append(T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))))
        return with_columns(docs, make, fields, column=text, size=2_000_000)


def hash_of(x: bytes) -> int:
    return zlib.crc32(x)


def beginning(word: bytes) -> int:
    return zlib.crc32(word[:6]) % BEGINNINGS


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document.

    Spans are (start, end, p) in bytes of the UTF-8 text, end exclusive; a document below the threshold has none.
    """
    slim = docs.select("doc_id", "text")
    made = ToxicTagger.fit(slim, labels).scores(slim, spans="spans")
    held_out, predicted = remainder("doc_id", FOLDS) == HELD_OUT, F.col("score") >= THRESHOLD
    return made.select("doc_id", held_out.alias("held_out"), "score", predicted.cast("int").alias("predicted"), "spans")
