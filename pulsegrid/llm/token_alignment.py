"""Two tokenizers' tokens of the same text laid side by side: groups, links, and how often ids meet in the corpus.

A byte-level BPE (A) encodes a space and the text, a sentencepiece model (B) the text, in front of which it puts a space
itself. Both sequences cover the same bytes. Overlapping tokens of A and B are linked; tokens connected by links form a
group, which ends where both sides end a token.

* Every token points to the overlapping token of the other side that reaches farthest to the right; the last token of
  A in a group points to itself. Successors are doubled for all tokens of a piece of documents at once until nothing
  changes: each token then holds its group's terminal token, the group's label.
* Between two neighbouring ends of either side lies exactly one overlap, so the links are read off the merged ends.
* Links are counted per batch of documents; the batches' counts are added up by id pair, the highest count of each id of B is
  found, and each batch gets the counts of its own pairs back. What travels is one row for each batch and pair, and
  one packed row of links for each batch; no table of pairs is broadcast or held by one task.

Most words come again, so a worker keeps both sides' ids of words seen (a bounded table), and whether their bytes are the
word's; words that it lacks are encoded together, once for each piece. That is right for B because no piece of its vocabulary goes on with a space after another character (checked when
it is loaded). Texts that can't be cut so, or with a word whose bytes differ, are encoded whole.

Defined cases: null and empty texts, and texts whose joined tokens of a side differ from space and text (a text with
U+2581 in it), have no tokens: zeros and an empty string. Rows that repeat a ``doc_id`` count each for itself, also in
the corpus counts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.byte_bpe import KEPT_LENGTH, Codec, memo
from pulsegrid.llm.common import pieces, stored

#: An id pair is ``id of A * SIDE + id of B``.
SIDE = 1 << 16
#: Bytes of text that are aligned at once, and (document, pair) entries after which a batch is closed.
PIECE, BATCH_ENTRIES = 1_000_000, 2_000_000
#: Entries that a worker holds at most of words with both sides' ids, and in its codec's two tables.
KEPT_WORDS, CODEC_WORDS, CODEC_MATCHES = 300_000, 50_000, 50_000
#: Marks an id as B's in a word's entry.
B_SIDE = 1 << 31

_DOC = "struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_pairs:long,groups_sha256:string,groups:string>"
BATCHES = f"batch long, docs array<{_DOC}>, pairs array<long>, times array<long>, packed binary"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pieces:
    """A sentencepiece model with the ids of words seen, and the bytes of its pieces."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        shown = [self.model.id_to_piece(i) for i in ids]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, shown)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in shown)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.uint16)


class Pair:
    """Both tokenizers of a worker, the lengths of their tokens in bytes and the decimals of their ids."""

    def __init__(self, source: str, pattern: str, model: bytes) -> None:
        self.a, self.b = Codec(source, pattern, words=CODEC_WORDS, matches=CODEC_MATCHES), Pieces(model)
        self.a_length, self.b_length = (np.array([len(x) for x in side.bytes_of], dtype=np.int64) for side in (self.a, self.b))
        self.size = max(len(self.a_length), len(self.b_length))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]
        self.words: dict[str, bytes] = {}

    def _made(self, words: list[str]) -> dict[str, bytes]:
        """Ids of both sides (B's with ``B_SIDE``) of words after a space; nothing where a side's bytes are others."""
        made = {}
        for word, b in zip(words, self.b.model.encode(words, num_threads=1)):
            body, a = b" " + word.encode(), array(self.a.code, self.a.unit(word))
            same = all(b"".join(map(side.bytes_of.__getitem__, ids)) == body for side, ids in ((self.a, a), (self.b, b)))
            made[word] = array("I", [*a, *[i | B_SIDE for i in b]]).tobytes() if same else b""
        short = [w for w in words if len(w) <= KEPT_LENGTH][: max(0, KEPT_WORDS - len(self.words))]
        self.words.update((w, made[w]) for w in short)
        return made

    def _whole(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        body, text = b" " + raw, raw.decode()
        a, b = self.a.encode(body), self.b.encode(text)
        same = all(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) == body for side, ids in ((self.a, a), (self.b, b)))
        return (a, b) if same else None

    def _cut(self, raw: bytes | None) -> list[str] | None:
        text = raw.decode() if raw and self.b.by_word else ""
        units = self.a.units(" " + text) if text and "▁" not in text and text[-1] != " " else None
        return units and units[1:]

    def tokens(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
        return self.tokens_all([raw])[0]

    def tokens_all(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of each text, or None where it has no tokens."""
        cut = [self._cut(raw) for raw in texts]
        kept = [words and list(map(self.words.get, words)) for words in cut]
        lacking = dict.fromkeys(w for words, ids in zip(cut, kept) if ids and None in ids for w in compress(words, [x is None for x in ids]))
        made = self._made(list(lacking))
        found: list[tuple[np.ndarray, np.ndarray] | None] = []
        for raw, words, ids in zip(texts, cut, kept):
            if ids and None in ids:
                ids = [made[w] if x is None else x for w, x in zip(words, ids)]
            if ids and b"" not in ids:
                both = np.frombuffer(b"".join(ids), dtype=np.uint32)
                of_b = both >= B_SIDE
                found.append((both[~of_b].astype(self.a.ids), (both[of_b] ^ np.uint32(B_SIDE)).astype(np.uint16)))
            else:
                found.append(self._whole(raw) if raw else None)
        return found


def labels(a_ends: np.ndarray, b_ends: np.ndarray, a_before: np.ndarray, b_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of its group's terminal token of A, by doubling of successors.

    ``a_before[e]`` and ``b_before[e]``: how many tokens of a side end before place ``e``, which is also the number of the
    side's token that reaches over ``e`` or ends there.
    """
    n = len(a_ends)
    across = b_before[a_ends]
    successor = np.empty(n + len(b_ends), dtype=np.int64)
    successor[:n] = np.where(b_ends[across] > a_ends, n + across, np.arange(n))
    successor[n:] = a_before[b_ends]
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor[:n], successor[n:]
        successor = farther


def aligned_piece(pair: Pair, texts: list[bytes | None], keep: bool) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a piece's documents, its id pairs (sorted), and for each document in turn its different pairs by their
    places in that list and how many links hold them."""
    found = pair.tokens_all(texts)
    having = [i for i, f in enumerate(found) if f]
    rows: list[tuple] = [(0, 0, 0, 0, 0, "", "" if keep else None)] * len(texts)
    if not having:
        return rows, np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    n_a, n_b = (np.array([len(found[i][side]) for i in having]) for side in (0, 1))
    a, b = (np.concatenate([found[i][side] for i in having]).astype(np.int64) for side in (0, 1))
    del found
    a_ends, b_ends = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
    marks_a, marks_b = (np.zeros(int(a_ends[-1]) + 1, dtype=np.int32) for _ in "ab")
    marks_a[a_ends], marks_b[b_ends] = 1, 1
    ends = np.flatnonzero(marks_a | marks_b)
    a_before, b_before = np.cumsum(marks_a) - marks_a, np.cumsum(marks_b) - marks_b
    label_a, label_b = labels(a_ends, b_ends, a_before, b_before)

    terminal = label_a == np.arange(len(a))
    rank = np.cumsum(terminal) - 1
    group_a, group_b = rank[label_a], rank[label_b]
    groups = int(rank[-1]) + 1
    b_through, a_through = np.cumsum(np.bincount(group_b, minlength=groups)), np.cumsum(np.bincount(group_a, minlength=groups))
    b_first = b_through - np.bincount(group_b, minlength=groups)
    shown = np.empty(len(a) + len(b), dtype=np.int64)
    shown[np.arange(len(a)) + b_first[group_a]] = a + pair.size * terminal
    shown[np.arange(len(b)) + a_through[group_b]] = b + 2 * pair.size * np.append(group_b[1:] != group_b[:-1], True)
    marks = list(map(pair.shown.__getitem__, shown.tolist()))

    a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
    n_groups = np.diff(group_a[a_stop - 1] + 1, prepend=0)
    link_stop = np.searchsorted(ends, a_ends[a_stop - 1], side="right")
    n_links = np.diff(link_stop, prepend=0)
    codes = a[a_before[ends]] * SIDE + b[b_before[ends]]
    place, pairs = pd.factorize(codes, sort=True)
    doc = np.repeat(np.arange(len(having)), n_links)
    entries, times = np.unique(doc * len(pairs) + place, return_counts=True)
    n_pairs = np.bincount(entries // len(pairs), minlength=len(having))
    for k, i in enumerate(having):
        stop = a_stop[k] + b_stop[k]
        text = "".join(marks[stop - n_a[k] - n_b[k] : stop])[:-1]
        rows[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), int(n_pairs[k]), hashlib.sha256(text.encode()).hexdigest(), text if keep else None)
    return rows, pairs, (entries % len(pairs)).astype(np.uint32), times.astype(np.uint32)


def packed(place: np.ndarray, times: np.ndarray) -> bytes:
    """Places (ascending inside each document) as differences, and counts, byte plane by byte plane."""
    change = np.diff(place.astype(np.uint32), prepend=np.uint32(0))
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T) for x in (change, times)]
    return pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True)


def unpacked(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(body, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(2, 4, n)
    change, times = (np.ascontiguousarray(p.T).view("<u4").reshape(-1) for p in planes)
    return np.cumsum(change, dtype=np.uint32), times


def aligned(docs: DataFrame, source: str, pattern: str, model: bytes, text: str = "text", keep: bool = False) -> DataFrame:
    """Batches of documents: their rows, the id pairs that they link, how often, and their packed links."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    name = "pair" + hashlib.sha256(source.encode() + pattern.encode() + model).hexdigest()
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(BATCHES))
    fields = [f.name for f in schema.field("docs").type.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rows: list[dict] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([p for p, _, _ in parts]))
            place = np.concatenate([np.searchsorted(pairs, p).astype(np.uint32)[at] for p, at, _ in parts])
            times = np.concatenate([t for _, _, t in parts])
            total = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, rows, pairs, total, packed(place, times)), schema.types)], names=schema.names)

        for whole in batches:
            for piece in pieces(whole, "text", rows=20_000, size=PIECE):
                pair = memo(name, lambda: Pair(source, pattern, model))
                made, *links = aligned_piece(pair, piece.column("text").to_pylist(), keep)
                rows += [dict(zip(fields, (i, *r))) for i, r in zip(piece.column("doc_id").to_pylist(), made)]
                parts.append(tuple(links))
                if sum(len(t) for _, _, t in parts) >= BATCH_ENTRIES:
                    yield batch()
                    rows, parts, number = [], [], number + 1
        if rows:
            yield batch()

    return inner.mapInArrow(run, BATCHES)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, links, best): corpus-wide links of every id pair, and whether no pair of its id of B has more."""
    used = batches.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counted = used.groupBy("pair").agg(F.sum("n").alias("links"))
    return counted.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy(F.col("pair") % SIDE)))  # an id of B meets at most the ids of A


def scored(rows: DataFrame) -> DataFrame:
    """Documents of batches that have come together with their pairs' corpus counts (``counts``, in the pairs' order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                docs = whole.column("docs")[r].values
                col = {f.name: docs.field(i) for i, f in enumerate(docs.type)}
                n_pairs = col["n_pairs"].to_numpy()
                found = whole.column("counts")[r].values
                stop = np.cumsum(n_pairs)
                sums = np.zeros((2, len(stop)), dtype=np.int64)
                if found is not None and len(found):
                    links, best = found.field(1).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)
                    place, times = unpacked(whole.column("packed")[r].as_py(), int(stop[-1]))
                    for k, value in enumerate((best.astype(np.int64), links)):
                        upto = np.concatenate([[0], np.cumsum(times * value[place])])
                        sums[k] = upto[stop] - upto[stop - n_pairs]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                yield pa.RecordBatch.from_arrays([*(col[c] for c in names), pa.array(sums[0]), pa.array(sums[1]), col["groups_sha256"], col["groups"]], names=[*names, "n_best", "count_sum", "groups_sha256", "groups"])

    return rows.mapInArrow(run, ROWS + ", groups string")


def alignments(docs: DataFrame, source: str, pattern: str, model: bytes, text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``source``: JSON of the byte-level tokenizer, split by ``pattern``; ``model``: the sentencepiece file's bytes. With
    ``keep`` the groups come too (``a1,a2|b1;a3|b2,b3``), else that column is null.
    """
    batches = stored(aligned(docs, source, pattern, model, text, keep), "alignment")
    used = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    counts = used.join(pair_counts(batches), "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "links", "best"))).alias("counts"))
    return scored(batches.select("batch", "docs", "packed").join(counts, "batch", "left").select("docs", "packed", "counts"))


def alignment_rows(docs: DataFrame, source: str, pattern: str, model: bytes) -> DataFrame:
    return alignments(docs, source, pattern, model).drop("groups")
