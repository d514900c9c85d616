"""Secrets in texts: known forms by pattern, and strings that look random by a battery of tests.

Patterns (leftmost, non-overlapping, each kind for itself): ``assign``, ``access``, ``hex``. Besides them every maximal
string of at least ``SHORTEST`` letters, digits and ``+ / _ -`` is a candidate. Its encoding is the smallest known alphabet
that holds all its characters; over that alphabet it is tested for

* uniformity: Pearson's chi-squared of the characters' counts,
* runs: how often the string changes between the lower and the upper half of the alphabet (Wald and Wolfowitz),
* serial correlation of neighbouring characters' places in the alphabet.

A candidate whose smallest of the three p-values, times three, is under ``REJECT`` isn't random. Looking uniform is no
evidence by itself: a short string passes whatever it is. So the null hypothesis is ordinary text: characters drawn with
the frequencies that the alphabet's characters have in the whole corpus. The p-value is the chance that text of the
same length comes out as uniform as the candidate; it shrinks with the length. Benjamini and Hochberg's procedure, within
each octave of lengths and over all candidates of the corpus, keeps the expected share of false finds at ``RATE``.
The ranks it needs are counts of p-values in ``STEP`` wide classes of their logarithm, rounded to the upper end.

Defined cases: a null or empty text has no spans; a row that repeats a ``doc_id`` is reported by itself; the order of
candidates or their partitions has no influence; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import pieces, stored

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
SHORTEST, REJECT, RATE, STEP = 20, 0.001, 0.01, 0.01
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Known alphabets, the smallest first.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "hex_upper": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER, "base36_upper": _DIGITS + _UPPER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_", "base66": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_HELD = {name: frozenset(a) for name, a in ALPHABETS.items()}
#: The characters whose frequencies are counted, by code point.
COUNTED = [ord(c) for c in ALPHABETS["base66"]]


def encoding(s: str) -> str:
    """The smallest known alphabet that holds all characters of a candidate."""
    own = set(s)
    return next(name for name, held in _HELD.items() if own <= held)


def upper_tail(z: float) -> float:
    """Chance that a standard normal variable is above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(s: str, name: str) -> tuple[float, float, float, float]:
    """Chi-squared of a string over its alphabet, and the p-values of uniformity, runs and serial correlation."""
    place, size, n = _PLACE[name], len(ALPHABETS[name]), len(s)
    x = np.array([place[c] for c in s])
    counts = np.bincount(x, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    free = size - 1
    # Wilson and Hilferty: the cube root of chi-squared over its mean is nearly normal
    z = ((max(chi, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    uniform = 2 * min(upper_tail(z), upper_tail(-z))
    high = x >= size // 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        alternation = 2 * upper_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        alternation = 2.0 ** (1 - n)
    centred = x - x.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    serial = 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n))
    return chi, uniform, alternation, serial


def text_chance(chi: float, length: int, size: int, squares: float, cubes: float) -> float:
    """Chance that ``length`` characters of text are at most as far from uniform as ``chi``.

    ``squares`` and ``cubes``: sums of the second and third powers of the alphabet's character frequencies in text. The
    chi-squared of such characters has this mean and variance; its lower tail is taken as normal.
    """
    mean = size * (1 - squares) + length * (size * squares - 1)
    spread = 4 * size**2 * (length - 1) / length * ((squares - squares**2) / 2 + (length - 2) * (cubes - squares**2))
    return upper_tail((mean - chi) / math.sqrt(spread)) if spread > 0 else 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all pattern matches that are long enough, in order."""
    out = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the candidates that no pattern match touches."""
    starts, reach = [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or reach[before - 1] <= m.start():
            out.append((m.start(), m.end(), m.group()))
    return out


SCANNED = "key long, doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:long,kind:int,end:long>>, letters array<long>, found array<struct<start:long,end:long,encoding:string,length:int,chi:double,p_uniform:double,p_runs:double,p_serial:double>>"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its pattern spans, its candidates with their tests, its counts of characters."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    fields = StructType.fromDDL(SCANNED).fields
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            for piece in pieces(whole, "text"):
                rows = []
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    raw = raw or b""
                    body = raw.decode("utf-8")
                    base = base_spans(body)
                    kinds = [k for _, k, _ in base]
                    found = []
                    for start, end, s in candidates(body, base):
                        name = encoding(s)
                        chi, *chances = battery(s, name)
                        found.append(dict(zip(("start", "end", "encoding", "length", "chi", "p_uniform", "p_runs", "p_serial"), (start, end, name, len(s), chi, *chances))))
                    letters = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)[COUNTED]
                    rows.append((key, doc_id, kinds.count(0), kinds.count(1), kinds.count(2), [{"start": a, "kind": k, "end": b} for a, k, b in base], letters, found))
                    key += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.name for f in fields])

    return source.mapInArrow(run, SCANNED)


def frequencies(rows: DataFrame) -> dict[str, tuple[int, float, float]]:
    """For each alphabet its size and the sums of the second and third powers of its characters' shares in all texts."""
    got = rows.agg(*[F.sum(F.col("letters")[i]).alias(f"n{i}") for i in range(len(COUNTED))]).first()
    count = {c: float(got[i] or 0) for i, c in enumerate(COUNTED)}
    out = {}
    for name, alphabet in ALPHABETS.items():
        own = np.array([count[ord(c)] for c in alphabet])
        share = own / own.sum() if own.sum() else np.full(len(own), 1 / len(own))
        out[name] = (len(alphabet), float((share**2).sum()), float((share**3).sum()))
    return out


def discoveries(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(key, start, end) of the candidates that Benjamini and Hochberg's procedure keeps, octave of lengths by octave."""
    classed = found.withColumn("band", F.floor(F.log2("length"))).withColumn("class", F.floor(F.log10(F.greatest("p", F.lit(1e-300))) / STEP))
    sizes = classed.groupBy("band", "class").agg(F.count("*").alias("n"))  # at most 300 / STEP rows for each octave
    up = Window.partitionBy("band").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("rank", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    passed = ranked.where(F.pow(F.lit(10.0), (F.col("class") + 1) * STEP) <= rate * F.col("rank") / F.col("all"))
    limit = passed.groupBy("band").agg(F.max("class").alias("limit"))
    return classed.join(F.broadcast(limit), "band").where("class <= limit").select("key", "start", "end")  # a row for each octave


def secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """key, doc_id, n_assign, n_access, n_hex, base and extra (arrays of spans) of every row of ``docs``."""
    rows = stored(scanned(docs, text), "secret-scan")
    share = frequencies(rows)
    everything = rows.select("key", F.explode("found").alias("f")).select("key", "f.*")

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [text_chance(chi, n, *share[name]) for chi, n, name in zip(*(b.column(c).to_pylist() for c in ("chi", "length", "encoding")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "start", "end", "length", "random")), pa.array(p, pa.float64())], names=["key", "start", "end", "length", "random", "p"])

    tested = everything.withColumn("random", 3 * F.least("p_uniform", "p_runs", "p_serial") >= REJECT)
    valued = tested.mapInArrow(chances, "key long, start long, end long, length int, random boolean, p double")
    # what the battery calls not random stays among the hypotheses, with nothing said against text
    extra = discoveries(valued.withColumn("p", F.when(F.col("random"), F.col("p")).otherwise(1.0)), rate)
    listed = extra.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("extra"))
    return rows.drop("letters", "found").join(listed, "key", "left").withColumn("extra", F.coalesce("extra", F.slice("base", 1, 0)))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, then kind), n_random."""
    rows = secrets(docs).withColumn("spans", F.array_sort(F.concat("base", "extra")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size("extra").cast("long").alias("n_random"))
