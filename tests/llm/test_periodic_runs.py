import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm.periodic_runs import intervals, periodic_tail, run_rows, runs_of, z_function
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.01"


def plain_runs(words):
    """Every run by its definition: all periods, all stretches of agreeing places, the smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    if rewrite:
        words = periodic_tail(doc_id, words)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def row(r):
    return tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def test_documents_against_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 6000")
    own = {r["doc_id"]: row(r) for r in run_rows(short).collect()}
    rows = short.collect()
    assert len(own) == len(rows) and all(own[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in rows)
    assert sum(v[1] > 0 for v in own.values()) > 20


def nested(seed):
    """Texts of a few words that repeat on several scales at once."""
    rng = random.Random(seed)
    words = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
    while len(words) < 400:
        cut = rng.randint(0, len(words))
        words = words[:cut] + words * rng.randint(1, 5) + [rng.choice("abc") for _ in range(rng.randint(0, 3))]
    return words[: rng.randint(100, 1500)]


def test_nested_and_degenerate_repetitions(spark):
    texts = [" ".join(nested(i)) for i in range(60)] + ["a " * n for n in (1, 5, 6, 7, 8, 40, 3000)] + ["a b " * n for n in (3, 4, 700)] + ["a a b " * 900 + "c " + "a b b " * 300]
    texts += ["x y " * 3 + "x", " ".join("ab"[bin(i).count("1") % 2] for i in range(2048))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(7)
    own = {r["doc_id"]: r for r in runs_of(docs).collect()}
    for i, t in enumerate(texts):
        assert [(r["start"], r["length"], r["period"]) for r in own[i]["runs"] or []] == plain_runs(t.encode().split()), i


def test_tables_of_odd_rows(spark):
    docs = documents(spark)
    odd = docs.unionByName(docs.where("doc_id < 6")).unionByName(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "repeat('p q ', 50) text", "lang", "source", "n_chars", "key", "kept"))
    out = [row(r) for r in run_rows(odd).collect()]
    expected = [plain_row(r["doc_id"], r["text"], rewrite=r["doc_id"] is not None) for r in odd.collect() if (r["text"] or "").count(" ") < 5000]
    assert len(out) == odd.count() and set(expected) <= set(out)
    assert sorted(out, key=repr) == sorted((row(r) for r in run_rows(odd.repartition(5)).collect()), key=repr)
    assert run_rows(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_z_function(s):
    assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("left", [0, 2, 4])
def test_tile_without_a_run_gives_nothing(left):
    assert intervals(list(range(20)), left, 4, False, False) == []
