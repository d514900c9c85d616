"""Periodic runs in the words of documents: stretches that repeat themselves at least four times.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), of at least
``max(6, 4 q)`` words, that no neighbouring word extends. Periods are searched by octaves ``[P, 2P)``:

1. A document is cut into overlapping tiles for each octave. A run of the octave has at least ``3 q`` places ``i`` with
   ``word[i] == word[i + q]``, so a boundary of the octave's grid lies in it with ``2P`` such places behind it. Only
   boundaries whose next ``2P`` words come again at a distance inside the octave make a tile (rolling hashes by
   doubling, linear for each octave; a false alarm costs one tile, nothing is lost). Tiles of neighbouring
   boundaries, of a bounded number, travel as one strip, so that the words that tiles share are written once.
2. Strips are dealt over all tasks and their tiles solved independently: the Z-function of the words behind the boundary
   gives, for every period of the octave, how far the words agree to the right, that of the reversed words how far to
   the left. Each answer is an interval of agreeing places, cut off where the tile ends; a strip joins its own.
3. Intervals are shuffled by (document, period) and stitched where they meet. Of equal stretches the smallest period
   is the run's; multiples of it find the same stretch and go.

Defined cases: a null or empty text has no words and no run; a row that repeats a ``doc_id`` is a document of its own;
a document whose ``doc_id`` is null is never rewritten; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import pieces, stored

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Strips of one output batch hold about so many words; a strip has tiles for so many words, or so many tiles at least.
BATCH_WORDS, STRIP_WORDS, STRIP_TILES = 1 << 20, 4096, 16

PARTS = "key long, doc_id long, digest string, words binary, octave int, at long, tiles long, n long, start long, ids array<int>"
Rewrite = Callable[[int, list[bytes]], list[bytes]]


def spacing(octave: int) -> int:
    """Words between two boundaries of an octave; with the ``2 * octave`` words that a boundary needs behind it, a run's agreeing places hold one."""
    return 4 if octave == 1 else octave


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal the first items; the whole length for the first place."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def boundaries(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) of documents that lie one behind another in ``ids``, the longest first.

    A boundary is given where its next ``2 * octave`` words come again, inside its document, at a distance of the octave.
    """
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    ends = np.cumsum(lengths)
    octave = 1
    while len(lengths) and lengths[0] >= max(LEAST_WORDS, LEAST_PERIODS * octave):
        kept = int(np.searchsorted(-lengths, -LEAST_PERIODS * octave, side="right"))
        lengths, ends = lengths[:kept], ends[:kept]
        ids = ids[: ends[-1]]
        hashes = hashes[: len(ids) - octave + 1]
        # from blocks of ``octave`` words to blocks twice as long
        mixed = hashes[:-octave] * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes = (mixed ^ (mixed >> np.uint64(31))) + hashes[octave:]
        grid = np.append(hashes, np.zeros(-len(hashes) % octave, dtype=np.uint64)).reshape(-1, octave)
        here, later = grid[:-1, :1], grid[1:]
        if octave == 1:
            here, later = here[:: spacing(1)], later[:: spacing(1)]
        same = later == here
        hit = np.flatnonzero(same.any(axis=1))
        nearest = octave + same[hit].argmax(axis=1)
        at = hit * spacing(octave)
        inside = at + nearest + 2 * octave <= ends[np.searchsorted(ends, at, side="right")] if len(at) else np.zeros(0, bool)
        yield octave, at[inside]
        octave *= 2


def strips(at: np.ndarray, doc: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Which boundaries begin a strip, and how many tiles each strip has: neighbours of one document, a bounded number."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(at))
    alone = np.concatenate([[True], (np.diff(at) != spacing(octave)) | (np.diff(doc) != 0)])
    since = place - np.maximum.accumulate(np.where(alone, place, 0))
    first = np.flatnonzero(since % max(STRIP_TILES, STRIP_WORDS // spacing(octave)) == 0)
    return first, np.diff(np.append(first, len(at)))


def intervals(ids: list[int], left: int, octave: int, opens: bool, closes: bool) -> list[tuple[int, int, int]]:
    """(period, places before the boundary, places behind it) of the agreeing places around a tile's boundary.

    ``left`` words of the tile lie before the boundary; ``opens`` and ``closes`` say that the document begins or ends
    with the tile. What ends inside the tile and is too short for a run is left out.
    """
    right = ids[left:]
    ahead = z_function(right)
    periods = [q for q in range(octave, min(2 * octave, len(right))) if ahead[q] >= 2 * octave]
    if not periods:
        return []
    far = periods[-1]
    before = ids[:left][::-1]
    back = z_function([*before, -1, *ids[: left + far][::-1]])
    out = []
    for q in periods:
        x, y = min(left, back[left + 1 + far - q]), ahead[q]
        whole = (x < left or opens) and (q + y < len(right) or closes)
        if not whole or x + y >= max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q):
            out.append((q, x, y))
    return out


def tiled(docs: DataFrame, text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """One row for each document (key, doc_id, digest of its words joined by a space, and its words if it has tiles)
    and one for each strip (key, octave, first boundary, tiles, words of the document, first word, word numbers)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    names = [c.split()[0] for c in PARTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]

    def batch(**columns: object) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * rows), t) for c, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            for piece in pieces(whole, "text"):
                doc_ids = piece.column("doc_id").to_pylist()
                listed = [(x or b"").split() for x in piece.column("text").to_pylist()]
                if rewrite:
                    listed = [w if i is None else rewrite(i, w) for i, w in zip(doc_ids, listed)]
                order = sorted(range(len(listed)), key=lambda i: -len(listed[i]))
                lengths = np.array([len(listed[i]) for i in order], dtype=np.int64)
                begins, number = np.cumsum(lengths) - lengths, {}
                ids = np.array([number.setdefault(w, len(number)) for i in order for w in listed[i]], dtype=np.int32)
                having = np.zeros(len(order), dtype=bool)
                for octave, at in boundaries(ids, lengths):
                    doc = np.searchsorted(begins, at, side="right") - 1
                    having[doc] = True
                    first, tiles = strips(at, doc, octave)
                    at, doc = at[first], doc[first]
                    lo = np.maximum(at - spacing(octave), begins[doc])
                    hi = np.minimum(at + tiles * spacing(octave) + 4 * octave, begins[doc] + lengths[doc])
                    share = max(1, BATCH_WORDS // (STRIP_WORDS + (STRIP_TILES + 6) * octave))
                    for j in range(0, len(at), share):
                        s = slice(j, j + share)
                        offsets = np.concatenate([[0], np.cumsum(hi[s] - lo[s])]).astype(np.int32)
                        values = np.concatenate([ids[a:b] for a, b in zip(lo[s], hi[s])])
                        yield batch(
                            key=key + np.array(order)[doc[s]], octave=np.full(len(at[s]), octave), at=at[s] - begins[doc[s]], tiles=tiles[s], n=lengths[doc[s]],
                            start=lo[s] - begins[doc[s]], ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                        )
                cut = {order[k] for k in np.flatnonzero(having)}
                joined = [b" ".join(w) for w in listed]
                yield batch(
                    key=list(range(key, key + len(listed))), doc_id=doc_ids, digest=[hashlib.sha256(x).hexdigest() for x in joined],
                    words=[x if i in cut else None for i, x in enumerate(joined)],
                )
                key += len(listed)

    return source.mapInArrow(run, PARTS)


def strip_intervals(ids: list[int], octave: int, at: int, tiles: int, n: int, start: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi) of the agreeing places that the tiles of a strip find, those of a period joined where they meet."""
    step = spacing(octave)
    out: list[tuple[int, int, int]] = []
    open_ones: dict[int, tuple[int, int]] = {}
    for b in range(at, at + tiles * step, step):
        lo, hi = max(b - step, 0), min(b + 4 * octave + step, n)
        for q, x, y in intervals(ids[lo - start : hi - start], b - lo, octave, lo == 0, hi == n):
            began, ended = open_ones.get(q, (b - x, -1))
            if began < b - x and ended < b - x:
                out.append((q, began, ended))
                began = b - x
            open_ones[q] = (min(began, b - x), max(ended, b + y))
    return out + [(q, *x) for q, x in open_ones.items()]


def solved(strips: DataFrame) -> DataFrame:
    """(key, period, lo, hi): intervals of places ``i`` with ``word[i] == word[i + period]``, cut off where strips end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, octave, at, tiles, n, start, ids in zip(*(b.column(c).to_pylist() for c in ("key", "octave", "at", "tiles", "n", "start", "ids"))):
                out += [(key, *x) for x in strip_intervals(ids, octave, at, tiles, n, start)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "period", "lo", "hi"])

    # a fixed number of partitions: small strips mean much work, so their size must not merge them into few tasks
    parts = int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strips.select("key", "octave", "at", "tiles", "n", "start", "ids").repartition(parts, "key", "octave", "at")
    return dealt.mapInArrow(run, "key long, period long, lo long, hi long")


def stitched(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs: intervals of a document and period joined where they meet."""
    by_place = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach >= F.col("lo"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("key", "period", "island").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    long = joined.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))
    return long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def collapsed(rows: DataFrame) -> DataFrame:
    """(key, collapsed_sha256) of rows with ``words`` and ``runs``: words behind a run's first period are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "words"):
                digests = []
                for words, runs in zip(b.column("words").to_pylist(), b.column("runs").to_pylist()):
                    listed = words.split(b" ")
                    change = np.zeros(len(listed) + 1, dtype=np.int64)
                    for r in runs:
                        change[r["start"] + r["period"]] += 1
                        change[r["start"] + r["length"]] -= 1
                    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    digests.append(hashlib.sha256(b" ".join([listed[i] for i in kept])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(digests, pa.string())], names=["key", "collapsed_sha256"])

    return rows.mapInArrow(run, "key long, collapsed_sha256 string")


def runs_of(docs: DataFrame, text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """A row for each row of ``docs``: key, doc_id, runs (array of start, period, length by start and period; null
    without any), collapsed_sha256 (words that a run repeats left out). ``rewrite`` changes a document's words before."""
    parts = stored(tiled(docs, text, rewrite), "run-tiles")
    runs = stitched(solved(parts.where("octave is not null")))
    lists = stored(runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs")
    bodies = parts.where("words is not null").select("key", "words")
    short = collapsed(bodies.join(lists, "key"))
    rows = parts.where("octave is null").select("key", "doc_id", "digest")
    return rows.join(lists, "key", "left").join(short, "key", "left").select("key", "doc_id", "runs", F.coalesce("collapsed_sha256", "digest").alias("collapsed_sha256"))


def periodic_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The planted repetition: for one document in ten, by its id's checksum, the words behind a place repeat."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def run_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), runs_sha256, collapsed_sha256."""
    rows = runs_of(docs, rewrite=periodic_tail)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("top", top)
    return rows.select(
        "doc_id", F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("top.length * 1000 div -top.period").alias("exponent_milli"),
        F.sha2(F.coalesce(F.array_join(lines, ""), F.lit("")).cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
