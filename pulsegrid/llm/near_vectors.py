"""Embedding near-dedup: robust-pruned flat graphs over overlapping cluster shards.

1. Equal vectors of a label become one class, so copies are never compared with each other.
2. Each label's classes are dealt to the ``overlap`` nearest of its centroids (k-means on a bounded sample).
3. Every shard builds a flat graph: of a node's nearest candidates robust pruning keeps those that no kept one covers.
   The adjacency lists of a node from all its shards are united.
4. In every shard each member searches the united graph greedily from the medoid and from itself; when it meets nodes in range, it
   expands through all of them (range search), and the hits are verified by cosine in double precision.
5. A pair belongs to the first shard that both members share and counts only there. Tasks send counts and the trees of
   their links, never all pairs of a group; components join the trees.
6. Recall is audited after every search: a bounded query set, random and among linked classes, is compared with all rows
   of its label. Labels below ``LEAST_RECALL`` are searched again with more overlap, and compared whole if ``MOST`` doesn't do.

A label's shards grow in number with its classes; centroids are fitted on at most ``SAMPLE`` vectors. Defined cases:
vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing and stay
alone; rows that repeat a ``vec_id`` count as vectors of their own. All vectors have one length. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored
from pulsegrid.llm.components import components

THRESHOLD = 0.93
SHARD = 700
SAMPLE = 20_000
OVERLAP = 3
#: From this overlap on, labels that fail the audit are compared whole.
MOST = 24
DEGREE, POOL, FAR, ALPHA, BEAM = 24, 64, 8, 1.2, 16
AUDIT = 200
LEAST_RECALL = 0.97
BLOCK = 256
#: Pairs that a task verifies at once.
PAIRS = 20_000
#: The range search also walks through nodes that miss the range by so much.
SLACK = 0.04


# ---- one shard's graph


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with their largest component between a half and one, by powers of two: squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and the same row of ``b`` (both :func:`scaled`): the one formula that decides a link."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def robust_prune(x: np.ndarray, of: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """For each node in ``of`` the kept ones of its candidates (rows of ``pool``, nearest first, -1 for none)."""
    near = x[pool]
    own = 1 - np.einsum("bcd,bd->bc", near, x[of])
    between = 1 - near @ near.transpose(0, 2, 1)
    alive = (pool >= 0) & (pool != of[:, None])
    kept = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    for k in range(degree):
        left = np.where(alive, own, np.inf)
        pick = left.argmin(axis=1)
        some = np.isfinite(left[rows, pick])
        if not some.any():
            break
        kept[some, k] = pool[rows, pick][some]
        covered = alpha * between[rows, pick] <= own
        alive &= ~(covered & some[:, None])
        alive[rows, pick] = False
    return [r[r >= 0] for r in kept]


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of one shard: pruned candidates and the links back."""
    n = len(x)
    links: list[list[int]] = [[] for _ in range(n)]
    back: list[list[int]] = [[] for _ in range(n)]
    size, rng = min(POOL, n), np.random.default_rng(n)
    for at in range(0, n, BLOCK):
        of = np.arange(at, min(n, at + BLOCK))
        like = x[of] @ x.T
        like[np.arange(len(of)), of] = 2.0
        pool = np.argpartition(-like, size - 1, axis=1)[:, :size]
        far = rng.integers(0, n, (len(of), FAR))  # some far candidates keep groups of near copies tied to the rest
        pool = np.concatenate([pool, far], axis=1)
        pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(like, pool, 1), axis=1), 1)
        for i, row in zip(of.tolist(), robust_prune(x, of, pool)):
            for j in row.tolist():
                links[i].append(j)
                back[j].append(i)
    return [np.unique(np.array(r + b, dtype=np.int64)) for r, b in zip(links, back)]


def _padded(links: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(links), max([1, *map(len, links)])), -1)
    for i, r in enumerate(links):
        out[i, : len(r)] = r
    return out


def range_search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, least: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of query nodes: (query node, found node) pairs with an inner product of at least ``least``."""
    n = len(x)
    table = _padded(links)
    medoid = int((x @ x.mean(axis=0)).argmax())
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        seen[:, medoid] = seen[rows, q] = True
        node = np.full((len(q), beam), -1)
        like = np.full((len(q), beam), -np.inf, dtype=np.float32)
        node[:, 0], like[:, 0] = medoid, x[q] @ x[medoid]
        node[:, 1], like[:, 1] = q, 1.0  # a member may start from itself too: a tight group can be an island
        done = np.zeros((len(q), beam), dtype=bool)
        close = like[:, 0] >= least - SLACK
        hits_q, hits_n, hits_v = [rows[close]], [np.full(int(close.sum()), medoid)], [like[close, 0]]
        while True:  # greedy: expand each query's best node that isn't expanded yet
            open_like = np.where(done | (node < 0), -np.inf, like)
            pick = open_like.argmax(axis=1)
            active = np.flatnonzero(np.isfinite(open_like[rows, pick]))
            if not len(active):
                break
            done[active, pick[active]] = True
            near = table[node[active, pick[active]]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            a, b = np.nonzero(fresh)
            who, what = active[a], near[a, b]
            seen[who, what] = True
            found = np.full(near.shape, -np.inf, dtype=np.float32)
            found[a, b] = np.einsum("ij,ij->i", x[q[who]], x[what])
            close = found[a, b] >= least - SLACK
            hits_q.append(who[close])
            hits_n.append(what[close])
            hits_v.append(found[a, b][close])
            all_node = np.concatenate([node[active], np.where(fresh, near, -1)], axis=1)
            all_like = np.concatenate([like[active], found], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, dtype=bool)], axis=1)
            best = np.argpartition(-all_like, beam - 1, axis=1)[:, :beam]
            node[active], like[active], done[active] = (np.take_along_axis(v, best, 1) for v in (all_node, all_like, all_done))
        who, what, value = np.concatenate(hits_q), np.concatenate(hits_n), np.concatenate(hits_v)
        all_who, all_what = [who[value >= least]], [what[value >= least]]
        while len(who):  # range: expand through every node in range, or nearly
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            nodes, begins = np.unique(what, return_index=True)
            new = np.zeros((len(q), n), dtype=bool)
            for u, rows_of in zip(nodes.tolist(), np.split(who, begins[1:])):
                new[rows_of[:, None], links[u]] = True
            new &= ~seen
            seen |= new
            who, what = np.nonzero(new)
            value = np.einsum("ij,ij->i", x[q[who]], x[what])
            all_who.append(who[value >= least])
            all_what.append(what[value >= least])
            who, what = who[value >= least - SLACK], what[value >= least - SLACK]
        yield q[np.concatenate(all_who)], np.concatenate(all_what)


# ---- shards


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors, from a fixed start."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
    return centres


def centroids(classes: DataFrame, sample: int, shard: int) -> dict[int, np.ndarray]:
    """Centroids of every label, fitted on at most ``sample`` classes picked by a hash of their ids."""
    counts = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(sample).collect()}
    picked = classes.select("label", "embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    by: dict[int, list] = {}
    for r in sorted(picked, key=lambda r: r["rep"]):
        by.setdefault(r["label"], []).append(r["embedding"])
    return {label: k_means(unit(np.array(v, dtype=np.float64)), min(len(v), -(-counts.get(label, 1) // shard))) for label, v in by.items()}


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def dealt(classes: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """A row for each class and shard: label, shard, rep, n, embedding, shards (of the class, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for label, rep, n, v in zip(*(b.column(c).to_pylist() for c in ("label", "rep", "n", "embedding"))):
                x = unit(np.array([v]))[0]
                own = centres.get(label)
                near = [0] if own is None else np.argsort(-(own @ x), kind="stable")[:overlap].tolist()
                out += [(label, s, rep, n, v, sorted(near)) for s in near]
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["label", "shard", "rep", "n", "embedding", "shards"])

    return classes.select("label", "rep", "n", "embedding").mapInArrow(run, "label int, shard int, rep long, n long, embedding array<double>, shards array<int>")


def shard_links(group: pa.Table) -> pa.Table:
    """Builds one shard's graph: (rep, near) rows."""
    reps = np.array(group.column("rep").to_pylist(), dtype=np.int64)
    order = np.argsort(reps)
    reps = reps[order]
    x = unit(_matrix(group.column("embedding"))[order]).astype(np.float32)
    links = build_graph(x)
    return pa.table({"rep": pa.array(reps), "near": pa.array([reps[r].tolist() for r in links], pa.list_(pa.int64()))})


def shard_search(threshold: float):
    """Searches one shard: rows (rep, links) with the linked vectors counted here, and rows (rep, other) of link trees."""

    def run(group: pa.Table) -> pa.Table:
        reps = np.array(group.column("rep").to_pylist(), dtype=np.int64)
        order = np.argsort(reps)
        reps = reps[order]
        here = group.column("shard")[0].as_py()
        raw = scaled(_matrix(group.column("embedding"))[order])
        n = np.array(group.column("n").to_pylist(), dtype=np.int64)[order]
        shards, near = ([group.column(c)[int(i)].as_py() or [] for i in order] for c in ("shards", "near"))
        x = unit(raw)
        single = x.astype(np.float32)
        links = []
        for r in near:
            at = np.searchsorted(reps, r)
            at = at[at < len(reps)]
            links.append(np.intersect1d(reps[at], r, assume_unique=False) if len(r) else np.zeros(0, dtype=np.int64))
        links = [np.searchsorted(reps, r) for r in links]
        of_shards = np.array(shards)
        counts = np.zeros(len(reps), dtype=np.int64)
        root = list(range(len(reps)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        g = len(reps)
        met = np.zeros(g * g // 8 + 1, dtype=np.uint8)  # a bit for each pair: found from either side, it counts once
        for a, b in range_search(single, links, np.arange(g), threshold - 1e-4):
            keep = a != b
            pairs = np.unique(np.minimum(a, b)[keep] * g + np.maximum(a, b)[keep])
            pairs = pairs[met[pairs >> 3] >> (pairs & 7).astype(np.uint8) & 1 == 0]
            np.bitwise_or.at(met, pairs >> 3, np.uint8(1) << (pairs & 7).astype(np.uint8))
            for at in range(0, len(pairs), PAIRS):
                lows, highs = pairs[at : at + PAIRS] // g, pairs[at : at + PAIRS] % g
                exact = cosines(raw[lows], raw[highs]) >= threshold
                lows, highs = lows[exact], highs[exact]
                common = (of_shards[lows][:, :, None] == of_shards[highs][:, None, :]).any(axis=2)
                own = of_shards[lows, common.argmax(axis=1)] == here  # the first shard that both are in
                np.add.at(counts, lows[own], n[highs[own]])
                np.add.at(counts, highs[own], n[lows[own]])
                for i, j in zip(lows.tolist(), highs.tolist()):
                    a_, b_ = find(i), find(j)
                    if a_ != b_:
                        root[max(a_, b_)] = min(a_, b_)
        linked = [i for i in range(len(reps)) if counts[i] or find(i) != i]
        return pa.table({"rep": pa.array(reps[linked]), "links": pa.array(counts[linked]), "other": pa.array([int(reps[find(i)]) for i in linked], pa.int64())})

    return run


def searched(classes: DataFrame, threshold: float, overlap: int, sample: int, shard: int) -> DataFrame:
    """(rep, links, other): see :func:`shard_search`."""
    rows = stored(dealt(classes, centroids(classes, sample, shard), overlap), "vector-shards")
    lists = rows.groupBy("label", "shard").applyInArrow(shard_links, "rep long, near array<long>")
    united = stored(lists.groupBy("rep").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")), "vector-graph")
    return stored(rows.join(united, "rep").groupBy("label", "shard").applyInArrow(shard_search(threshold), "rep long, links long, other long"), "vector-links")


def failing_labels(classes: DataFrame, found: DataFrame, threshold: float, least: float, queries: int = AUDIT) -> list[int]:
    """Labels in which less than ``least`` of the true links of a bounded query set were found, by comparing it with all rows.

    Half of the set is drawn by hash among all classes, half among those with links to others.
    """
    order = [F.xxhash64(F.lit(7), "rep"), F.col("rep")]
    counted = found.groupBy("rep").agg(F.sum("links").alias("found"))
    picked = classes.select("rep", "label", "embedding")
    linked = picked.join(counted.where("found > 0"), "rep", "left_semi")
    asked = list({r["rep"]: r for part in (picked, linked) for r in part.orderBy(*order).limit(queries).collect()}.values())
    if not asked:
        return []
    ids, labels = np.array([r["rep"] for r in asked]), np.array([r["label"] for r in asked])
    vectors = unit(np.array([r["embedding"] for r in asked], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_matrix(b.column("embedding")))
            n, lab, rep = (np.array(b.column(c).to_pylist()) for c in ("n", "label", "rep"))
            for i, v in enumerate(vectors):
                total[i] += int(n[(x @ v >= threshold) & (lab == labels[i]) & (rep != ids[i])].sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rep", "true"])

    true = classes.select("rep", "label", "n", "embedding").mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    both, of = true.join(counted, "rep", "left").collect(), dict(zip(ids.tolist(), labels.tolist()))
    sums: dict[int, list[int]] = {}
    for r in both:
        held = sums.setdefault(of[r["rep"]], [0, 0])
        held[0] += r["true"]
        held[1] += min(r["true"], r["found"] or 0)
    return sorted(label for label, (t, f) in sums.items() if f < least * t)


def tile_links(threshold: float):
    """All pairs of two blocks (``i`` <= ``j``), or of one: (rep, links, other) rows."""

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        group = group.sort_by("rep")
        reps, n, block = (np.array(group.column(c).to_pylist(), dtype=np.int64) for c in ("rep", "n", "block"))
        raw = scaled(_matrix(group.column("embedding")))
        x = unit(raw)
        counts, root = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for at in range(0, len(first), BLOCK):
            own = first[at : at + BLOCK]
            like = x[own] @ x[second].T
            close = np.nonzero(np.abs(like - threshold) < 1e-9)  # rounding may decide: by the formula of the search
            like[close] = cosines(raw[own[close[0]]], raw[second[close[1]]])
            hit = (like >= threshold) & (own[:, None] != second[None, :])
            counts[own] += hit @ n[second]
            if i != j:
                counts[second] += n[own] @ hit
            for row, a in enumerate(own.tolist()):
                if hit[row].any():
                    joined = np.unique(root[np.append(second[hit[row]], a)])
                    root[np.isin(root, joined)] = joined[0]
        linked = np.flatnonzero(counts)
        return pa.table({"rep": pa.array(reps[linked]), "links": pa.array(counts[linked]), "other": pa.array(reps[root[linked]])})

    return run


def compared(classes: DataFrame, threshold: float, block: int = 2000) -> DataFrame:
    """(rep, links, other) of all pairs of a label, as tiles of two blocks of about ``block`` classes."""
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = classes.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = own.select("label", "rep", "n", "embedding", "block", other.alias("k"))
    tiles = tiles.select("label", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "rep", "n", "embedding", "block")
    return stored(tiles.groupBy("label", "i", "j").applyInArrow(tile_links(threshold), "rep long, links long, other long"), "vector-tiles")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, sample: int = SAMPLE, shard: int = SHARD, least_recall: float = LEAST_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("embedding", lambda v: v != 0)
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    rows = stored(slim.withColumn("fit", F.coalesce(fit, F.lit(False))), "vectors")
    classes = stored(rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    found = searched(classes, threshold, overlap, sample, shard)
    while failing := failing_labels(classes, found, threshold, least_recall):
        again = F.col("label").isin(failing)
        rest = classes.where(again)
        kept = found.join(classes.where(~again).select("rep"), "rep", "left_semi")
        if overlap >= MOST:
            found = stored(kept.unionByName(compared(rest, threshold)), "vector-links")
            break
        overlap *= 2
        found = stored(kept.unionByName(searched(rest, threshold, overlap, sample, shard)), "vector-links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of = classes.join(counted, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left")
    of = stored(of.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-components")
    linked = rows.where("fit").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
