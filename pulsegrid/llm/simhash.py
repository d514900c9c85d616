"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two link when at most ``distance`` (up to 3) bits differ. Cut into a ring of eight segments
of eight bits, such a pair has a segment from which every chain of consecutive segments keeps its cumulative
differences within its share of the distance: chain of l segments, at most ``floor(l * distance / 8)``. For distance 3
that is 0, 0, 1, 1, 1, 2, 2, 3. Hence the first two segments are equal and of the next three at most one differs:
fingerprints that agree in those four segments (32 bits; 8 starts, 3 choices of the segment left out) meet as
candidates, the rest of the chain prunes them, and the full Hamming distance decides.

Equal fingerprints are one node, so copies never multiply. Inside a bucket links are joined into trees before they
leave the task: components lose nothing and output stays linear. Buckets hold different fingerprints that agree in 32
bits; they are compared in numpy blocks, never as emitted pairs. ``similar_components`` compares the shingles themselves.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; a text
shorter than a shingle is one shingle. Rows that repeat a ``doc_id`` get the same row each. A null ``doc_id`` never
names a component, which is null only if no member has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import stored, with_columns
from pulsegrid.llm.components import components

SEGMENTS, WIDTH = 8, 8
SEED = 42
#: Similar texts: segments of the sampled ring, and how many agree at least in a candidate.
RING, AGREE = 16, 6
#: Bytes of a bucket's shingle sets that a task keeps in memory.
HELD = 64_000_000
_ODDS = np.random.default_rng(SEED).integers(1, 1 << 63, RING, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, RING, dtype=np.uint64)
RINGS = ["r0", "r1", "r2", "r3"]


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's shingles of ``words`` words, repeats included, in bounded pieces."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not parts:
        return
    n = max(1, len(parts) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 1 << 14):
        stop = min(n, at + (1 << 14))
        runs = zip(*(parts[at + k : stop + k] for k in range(words))) if len(parts) > words else [parts]
        yield np.array([digest(s, SEED) for s in map(join, runs)], dtype="<u8")


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a text's shingles of ``words`` words, repeats included."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((total * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(x, words) for x in texts], dtype=np.uint64).view(np.int64)]

    return with_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), make, [T.StructField("fp", T.LongType())], keep=["doc_id"])


def _chains(fps: DataFrame) -> DataFrame:
    """(key, start, fp, id): the keys under which a fingerprint meets those that share a chain's first five segments but one."""
    keys = []
    for start in range(SEGMENTS):
        fp = F.col("fp")
        turned = F.shiftrightunsigned(fp, WIDTH * start).bitwiseOR(F.shiftleft(fp, 64 - WIDTH * start)) if start else fp
        for out in range(3):
            mask = ((1 << 5 * WIDTH) - 1) & ~(0xFF << (2 + out) * WIDTH)
            keys.append(turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((3 * start + out) << 40)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")


def _rotated(x: np.ndarray, start: int) -> np.ndarray:
    shift = np.uint64(WIDTH * start)
    return x if not start else (x >> shift) | (x << np.uint64(64 - WIDTH * start))


def close_pairs(fps: np.ndarray, others: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Boolean matrix: fingerprints whose chain from ``start`` stays within its budgets and that differ in few bits."""
    differ = fps[:, None] ^ others[None, :]
    turned = _rotated(differ, start)
    ok = np.ones(differ.shape, dtype=bool)
    for chain in range(1, SEGMENTS):
        part = turned & np.uint64((1 << chain * WIDTH) - 1)
        ok &= np.bitwise_count(part) <= chain * distance // SEGMENTS
        if not ok.any():
            return ok
    return ok & (np.bitwise_count(differ) <= distance)


def bucket_links(ids: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links of one bucket as trees, so no more links than nodes.

    ``close`` tells for two arrays of positions which pairs link. Every node reached is compared with the nodes not yet
    reached only, so a bucket of copies costs about one comparison a node, and no link between components is lost.
    """
    rest = np.arange(len(ids))
    a, b = [], []
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, min(1024, 1_000_000 // len(rest)))
            hit = close(front[:step], rest).any(axis=0)
            found, rest = rest[hit], rest[~hit]
            front = np.concatenate([front[step:], found])
            a += ids[found].tolist()
            b += [int(ids[root])] * len(found)
    return a, b


def _bucketed(rows: DataFrame, columns: list[str], each: Callable[[int, list[np.ndarray]], list], out: list[str]) -> DataFrame:
    """The longs ``out`` that ``each`` makes of every bucket of two rows and more, from its key and its columns of longs."""
    names = ["key", *columns]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, made = held[0], [[np.zeros(0, dtype=np.int64)] for _ in out]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        begins, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        for at in np.flatnonzero(ends - begins > 1).tolist():
            s, e = begins[at], ends[at]
            for column, part in zip(made, each(int(keys[s]), [c[s:e] for c in held[1:]])):
                column.append(np.asarray(part, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in made], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            now = [np.asarray(batch.column(c)) for c in names]
            if not len(now[0]):
                continue
            if held:
                now = [np.concatenate([h, r]) for h, r in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))
            held = [r[last:] for r in now]
            if last:
                yield flush([r[:last] for r in now])
        if held:
            yield flush(held)

    return rows.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in out))


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) among (fp, id) rows of different fingerprints, as trees inside each bucket."""
    if not 0 <= distance <= 3:
        raise ValueError("the chains of this layout hold distances up to 3")

    def each(key: int, columns: list[np.ndarray]) -> list:
        fp, start = columns[0].view(np.uint64), (key >> 40) // 3
        return list(bucket_links(columns[1], lambda i, j: close_pairs(fp[i], fp[j], start, distance)))

    return _bucketed(_chains(fps), ["fp", "id"], each, ["a", "b"])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Different shingle hashes of a text, ascending."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype="<u8")


def ring_of(hashes: np.ndarray) -> np.ndarray:
    """Sixteen segments of sixteen bits, each of the smallest hash under its own permutation; zeros without shingles."""
    if not len(hashes):
        return np.zeros(RING, dtype="<u2")
    return np.array([((hashes ^ x) * odd).min() for x, odd in zip(_XORS, _ODDS)], dtype=np.uint64).astype("<u2")


def ring_plausible(rings: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Boolean matrix: sizes that allow a similarity of 0.8, and ``AGREE`` equal segments or more."""
    same = np.zeros((len(i), len(j)), dtype=np.uint8)
    for at in range(RING):
        same += rings[i, at][:, None] == rings[j, at][None, :]
    a, b = n[i][:, None], n[j][None, :]
    return (same >= AGREE) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))


def with_partner(rings: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which members of a bucket have a plausible partner in it; members that have one aren't compared any more."""
    got = np.zeros(len(n), dtype=bool)
    step = max(1, min(1024, 4_000_000 // max(1, len(n))))
    for at in range(0, len(n), step):
        left, others = np.flatnonzero(~got), np.arange(at, min(len(n), at + step))
        got[left] = (ring_plausible(rings, n, left, others) & (left[:, None] != others[None, :])).any(axis=1)
    return got


def exact_close(flat: np.ndarray, ends: np.ndarray, rings: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Link test of a bucket: Jaccard similarity of 0.8 or more, in whole numbers; ``flat`` holds the members' shingle sets.

    A column that one row has linked is not compared with the following rows.
    """
    begins = np.r_[0, ends[:-1]]
    n = ends - begins

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        maybe = ring_plausible(rings, n, i, j)
        out, open_ = np.zeros(maybe.shape, dtype=bool), np.ones(len(j), dtype=bool)
        for row, one in enumerate(i.tolist()):
            columns = np.flatnonzero(maybe[row] & open_)
            own = np.asarray(flat[begins[one] : ends[one]])
            step = max(1, 2_000_000 // max(1, 2 * len(own)))
            for at in range(0, len(columns), step):
                some = columns[at : at + step]
                if not len(own):
                    out[row, some] = True  # plausible: no shingles either
                    continue
                others = np.concatenate([flat[begins[k] : ends[k]] for k in j[some].tolist()])
                found = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                shared = np.add.reduceat(found, np.r_[0, np.cumsum(n[j[some]])[:-1]], dtype=np.int64)
                out[row, some] = 9 * shared >= 4 * (len(own) + n[j[some]])
            open_ &= ~out[row]
        return out

    return close


def _segment(i: int):
    return F.shiftrightunsigned(RINGS[i % RING // 4], 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def ring_buckets(nodes: DataFrame) -> DataFrame:
    """(key, id, s1, s2) of the (s1, s2, n, r0..r3, id) rows that have a plausible partner under a key of two neighbouring segments.

    Of keys with the same members one stays.
    """
    keys = F.array(*[_segment(k).bitwiseOR(F.shiftleft(_segment(k + 1), 16)).bitwiseOR(F.lit(k << 48)) for k in range(RING)])

    def each(key: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        n, *ring, s1, s2, ids = columns
        rings = np.ascontiguousarray(np.stack(ring, axis=1)).view("<u2")
        got = with_partner(rings, n)
        return [np.full(int(got.sum()), key), ids[got], s1[got], s2[got]]

    names = ["n", *RINGS, "s1", "s2", "id"]
    members = stored(_bucketed(nodes.select(F.explode(keys).alias("key"), *names), names, each, ["key", "id", "s1", "s2"]), "ring-members")
    sums = members.groupBy("key").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.count("*").alias("size"))
    return stored(members.join(sums.groupBy("x1", "x2", "size").agg(F.min("key").alias("key")).select("key"), "key"), "ring-buckets")


def verified_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of similarity 0.8 or more among (key, id, r0..r3, shingles) rows, as trees inside each bucket.

    A bucket's shingle sets beyond ``HELD`` bytes lie in a file of the task, which goes with it.
    """

    def links(ids: list[int], rings: list[tuple], ends: list[int], file) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        if len(ids) > 1:
            file.flush()
            if not ends[-1]:
                flat = np.zeros(0, dtype="<u8")
            elif file._rolled:
                flat = np.memmap(file._file, dtype="<u8", mode="r")
            else:
                flat = np.frombuffer(file._file.getvalue(), dtype="<u8")
            of = np.array(rings, dtype=np.int64).reshape(-1, RING // 4).view("<u2")
            a, b = bucket_links(np.array(ids, dtype=np.int64), exact_close(flat, np.array(ends, dtype=np.int64), of))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tempfile import SpooledTemporaryFile

        now, ids, rings, ends, file = None, [], [], [], SpooledTemporaryFile(HELD)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "id", *RINGS)]
            for row, (key, i, *ring) in enumerate(zip(*columns)):
                if key != now:
                    if len(ids) > 1:
                        yield links(ids, rings, ends, file)
                    file.close()
                    now, ids, rings, ends, file = key, [], [], [], SpooledTemporaryFile(HELD)
                body = batch.column("shingles")[row].as_buffer()
                file.write(body)
                ids.append(i)
                rings.append(tuple(ring))
                ends.append((ends[-1] if ends else 0) + body.size // 8)
        if len(ids) > 1:
            yield links(ids, rings, ends, file)
        file.close()

    return rows.select("key", "id", *RINGS, "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, words: int = 5, text: str = "text", distance: int | None = None) -> DataFrame:
    """doc_id, component_id of every row: groups of texts linked by a Jaccard similarity of their shingles of 0.8 or more.

    Texts that share 0.8 of their shingles differ in about ten bits of 64, too many for chains of bits. Candidates
    therefore come from a ring of sixteen segments, each sixteen bits of the hash of one sampled shingle (the smallest
    under its own permutation): segments agree as often as the Jaccard similarity says. Two neighbouring equal segments
    are the key, at least ``AGREE`` equal segments and sizes within 0.8 make a candidate; a pair of similarity 0.8 is none in
    5 of 100,000 cases. Then the shingle sets themselves decide, inside the buckets, so that links stay trees. Texts of
    equal sets are one node.

    With ``distance`` (up to 3) texts also link by their fingerprints, as in :func:`near_components`, and components go
    over links of both kinds. A text stands between the node of its set and the node of its fingerprint.
    """

    def make(shingles: bool) -> Callable:
        def work(texts: list[bytes]) -> list:
            sets = [shingle_set(x, words) for x in texts]
            sums = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8") for s in sets]).reshape(-1, 2)
            rings = np.array([ring_of(s) for s in sets], dtype="<u2").reshape(-1, RING).view("<i8")
            out = [*np.ascontiguousarray(sums.T), *np.ascontiguousarray(rings.T)]
            if shingles:
                return [*out, [s.tobytes() for s in sets]]
            fps = np.zeros(len(texts), dtype=np.uint64) if distance is None else np.array([fingerprint(x, 3) for x in texts], dtype=np.uint64)
            return [*out, np.array([len(s) for s in sets], dtype=np.int64), fps.view(np.int64)]

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField(c, T.LongType()) for c in ("s1", "s2", *RINGS)]
    own = stored(with_columns(source, lambda: make(False), [*fields, T.StructField("n", T.LongType()), T.StructField("fp", T.LongType())], keep=["doc_id"]), "sketches")
    nodes = stored(own.groupBy("s1", "s2", "n", *RINGS).agg(F.min("doc_id").alias("id")), "sketch-nodes")
    buckets = ring_buckets(nodes.where("id is not null"))
    wanted = stored(buckets.select("id").distinct(), "sketch-wanted")
    texts = source.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    sets = stored(with_columns(texts, lambda: make(True), [*fields, T.StructField("shingles", T.BinaryType())], keep=["doc_id"]).withColumnRenamed("doc_id", "id"), "shingles")
    links = stored(verified_links(buckets.join(sets, ["id", "s1", "s2"])).distinct(), "sketch-links")
    if distance is None:
        of = nodes.join(components(links), "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
        return own.join(stored(of, "sketch-components"), ["s1", "s2"]).select("doc_id", "component_id")
    prints = fingerprint_nodes(own)
    both = own.select("s1", "s2", "fp").distinct().join(nodes.select("s1", "s2", F.col("id").alias("a")), ["s1", "s2"])
    both = stored(both.join(prints.select("fp", F.col("id").alias("b")), "fp"), "sketch-prints")
    near = fingerprint_links(prints.where("id is not null"), distance)
    found = components(links.unionByName(near).unionByName(both.where("a <> b").select("a", "b")))
    of = both.join(found, F.coalesce("a", "b") == F.col("id"), "left").select("s1", "s2", "fp", F.coalesce("component", "a", "b").alias("component_id"))
    return own.join(stored(of, "sketch-components"), ["s1", "s2", "fp"]).select("doc_id", "component_id")


def fingerprint_nodes(own: DataFrame) -> DataFrame:
    """(fp, id): the smallest id of every fingerprint."""
    return stored(own.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprint-nodes")


def near_components(docs: DataFrame, words: int = 3, distance: int = 3, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    own = stored(fingerprints(docs, words, text), "fingerprints")
    nodes = fingerprint_nodes(own)
    found = components(fingerprint_links(nodes.where("id is not null"), distance))
    of = stored(nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "fingerprint-components")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
