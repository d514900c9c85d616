import zlib

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import chain, quality, toxicity
from tests.llm.helpers import documents, empty, rows

SF = "/root/testdata/sf0.1"


def brute(c, score, first):
    """Marginals by enumeration of all label sequences of each sequence."""
    import itertools

    out, at = [], 0
    ends = [*np.flatnonzero(first)[1:].tolist(), len(score)]
    for end in ends:
        own, n = np.zeros(end - at), 0.0
        for y in itertools.product((0, 1), repeat=end - at):
            s = c.start[y[0]] + sum(score[at + i] * v for i, v in enumerate(y)) + sum(c.transition[a, b] for a, b in zip(y, y[1:]))
            own += np.exp(s) * np.array(y)
            n += np.exp(s)
        out += (own / n).tolist()
        at = end
    return np.array(out)


def test_marginals_against_enumeration_and_over_blocks():
    rng = np.random.default_rng(5)
    c = chain.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = rng.integers(1, 8, 60)
    first = np.zeros(lengths.sum(), dtype=bool)
    first[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    score = rng.normal(size=len(first)) * 2
    assert np.allclose(c.marginals(score, first), brute(c, score, first))
    assert len(c.marginals(score[:0], first[:0])) == 0


def test_fit_finds_neighbour_effects():
    rng = np.random.default_rng(6)
    y = np.repeat(rng.integers(0, 2, 400), 5)
    x = np.where(rng.random(len(y)) < 0.75, y, 1 - y)[:, None]
    first = np.arange(len(y)) % 5 == 0
    c = chain.fit(x, y, first, 2)
    p = c.marginals(c.scores(x), first)
    assert ((p > 0.5) == y).mean() > 0.85 > (x[:, 0] == y).mean() and c.transition[0, 0] > c.transition[0, 1]


@pytest.mark.parametrize(("label", "fit", "divisor", "rest"), [("quality", quality.QualityModel.fit_rows, 5, 0), ("toxic", toxicity.ToxicTagger.fit_rows, 4, 2)])
def test_held_out_accuracy(label, fit, divisor, rest):
    found = duckdb.sql(f"select doc_id, text, {label} from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) order by 1").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % divisor == rest
    model = fit([(i, t.encode(), y) for i, t, y in found if not fold(i)][:2500])
    held = [(t.encode(), y) for i, t, y in found if fold(i)]
    p, y = model.score([t for t, _ in held]), np.array([v for _, v in held])
    assert ((p >= 0.3) == y).mean() > 0.97
    assert p.min() >= 0 and p.max() <= 1
    assert len(model.score([b"", b" \n\n", b"x " * 50_000])) == 3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_rows_of_odd_tables(spark, module):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2 if i != 4 else None) for i in range(12)], "doc_id long, quality int, toxic int")
    out = module.scored_rows(docs, labels)
    fold = {quality: (5, 0), toxicity: (4, 2)}[module]
    assert [(r["doc_id"], r["held_out"], r["predicted"] == int(r["score"] >= 0.3)) for r in sorted(out.collect())] == [(i, zlib.crc32(str(i).encode()) % fold[0] == fold[1], True) for i in range(17)]
    assert module.scored_rows(empty(spark), labels).count() == 0
    none = module.scored_rows(docs, labels.where("false"))
    assert {r["score"] for r in none.collect()} == {1.0 if module is quality else 0.0}
    for parts in (1, 3, 50):
        assert rows(out, "doc_id", "score") == rows(module.scored_rows(docs.repartition(parts), labels), "doc_id", "score")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_a_score_is_the_same_bits_in_any_batch(module):
    kind = {quality: quality.QualityModel, toxicity: toxicity.ToxicTagger}[module]
    label = {quality: "quality", toxicity: "toxic"}[module]
    found = duckdb.sql(f"select doc_id, text, {label} from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) order by 1 limit 900").fetchall()
    model = kind.fit_rows([(i, t.encode(), y) for i, t, y in found[:500]])
    texts = [t.encode() for _, t, _ in found[500:]] + [b"", b"x " * 30_000, b"one\n" * 2000]
    alone = [model.score([t])[0] for t in texts]
    assert model.score(texts).tolist() == alone and model.score(texts[::-1]).tolist() == alone[::-1]
    assert np.concatenate([model.score(texts[i : i + 7]) for i in range(0, len(texts), 7)]).tolist() == alone


def test_sequences_do_not_touch_each_other():
    rng = np.random.default_rng(8)
    c = chain.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = [1, 2, 15, 16, 17, 255, 256, 257, 5000, 3]
    parts = [rng.normal(size=n) * 3 for n in lengths]
    alone = [c.marginals(x, np.arange(len(x)) == 0) for x in parts]
    for order in (range(10), range(9, -1, -1), (4, 8, 0, 6)):
        first = np.concatenate([np.arange(lengths[i]) == 0 for i in order])
        assert np.array_equal(c.marginals(np.concatenate([parts[i] for i in order]), first), np.concatenate([alone[i] for i in order]))


def test_spans_point_at_the_words():
    found = [(i, f"one a{i} {w} b{i} four".encode(), y) for i in range(400) for w, y in ((f"grim{i % 3}", 1), ("kind", 0))]
    tagger = toxicity.ToxicTagger.fit_rows(found)
    text = "é one GRIM1, five grim2 grim0".encode()
    assert [text[a:b] for a, b, _ in tagger.spans(text)] == [b"GRIM1,", b"grim2 grim0"]


def test_rows_carry_the_offending_spans(spark):
    found = [(i, f"one a{i} {w} b{i} four", y) for i in range(400) for w, y in ((f"grim{i % 3}", 1), ("kind", 0))]
    docs = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(found)] + [(900, None), (901, ""), (902, "é GRIM1, x grim2 grim0 y")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, y) for n, (_, _, y) in enumerate(found)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.scored_rows(docs, labels).collect()}
    assert out[900]["spans"] == out[901]["spans"] == []
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for i, r in out.items():
        words = [texts[i][s["start"] : s["end"]].decode() for s in r["spans"]]
        assert (r["predicted"] == 1) == bool(words) and (i >= 900 or words == [w for w in texts[i].decode().split() if w.startswith("grim")])
    assert [texts[902][s["start"] : s["end"]] for s in out[902]["spans"]] == [b"GRIM1,", b"grim2 grim0"]
