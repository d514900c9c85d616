import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import simhash
from pulsegrid.llm.common import SPACE
from pulsegrid.llm.components import components
from pulsegrid.llm.cuckoo import CuckooFilter
from pulsegrid.llm.exact_dedup import ContentIndex, dedup_exact
from pulsegrid.llm.line_dedup import LineIndex, digest_rows
from tests.llm.helpers import LINE, documents, empty, rows


def test_cuckoo_filter_holds_deletes_and_overflows():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    f = CuckooFilter(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    again = CuckooFilter(0, f.to_bytes())
    assert again.contains(keys[2500:]).all()
    assert not CuckooFilter(10).insert(keys)


def brute_lines(docs):
    key = lambda x: x.strip(SPACE).lower()
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").encode().split(b"\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    docs = documents(spark)
    assert rows(digest_rows(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert digest_rows(empty(spark)).count() == 0


def test_lines_keep_columns_and_null_ids(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, LINE, None, None, None, None, None)], documents(spark).schema))
    out = LineIndex().insert(docs).apply(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert [r["text"] for r in out.where("doc_id is null").collect()] == [LINE]


def test_line_index_is_reversible(spark):
    docs = documents(spark)
    some, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = LineIndex().insert(some)
    whole = index.insert(rest)
    back = whole.delete(rest.select("doc_id"))
    state = lambda x: rows(x.index.entries(), "key", "refs", "top")
    assert state(whole) == state(LineIndex().insert(docs))
    assert state(back) == state(index) and rows(back.index.holders(), "key", "doc_id") == rows(index.index.holders(), "key", "doc_id")


def test_exact_against_brute_force(spark):
    docs = documents(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256((r["text"] or "").encode().lower()).hexdigest()].append(r["doc_id"])
    want = sorted(((i, max(g), len(g), i == max(g), k) for k, g in groups.items() for i in g), key=repr)
    assert rows(dedup_exact(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert dedup_exact(empty(spark)).count() == 0
    left = ContentIndex().insert(docs).delete(docs.where("doc_id = 7").select("doc_id")).groups()
    assert {r["keep_id"] for r in left.where("doc_id in (5, 6)").collect()} == {6}


def brute_fingerprint(text, words):
    import xxhash

    p = (text or "").encode().lower().split()
    s = [b" ".join(p[k : k + words]) for k in range(max(1, len(p) - words + 1))] if p else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_against_brute_force(spark):
    docs = documents(spark)
    found = {r["doc_id"]: r for r in simhash.near_rows(docs).collect()}
    for r in docs.where("length(text) < 1000 or text is null").collect():
        assert found[r["doc_id"]]["fingerprint"] == format(brute_fingerprint(r["text"], 3), "016x")
    assert found[7]["component_id"] == 5 and found[1]["component_id"] == 0
    assert simhash.near_rows(empty(spark)).count() == 0


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5)]
    fps = sorted(set(fps))
    made = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, id long").repartition(7)
    got = {r["id"]: r["component"] for r in components(simhash.fingerprint_links(made)).collect()}
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got.get(i, i) for i in range(len(fps))] == root
    with pytest.raises(ValueError):
        simhash.fingerprint_links(made, 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_a_chain_starts_somewhere_for_every_close_pair(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    a, b = np.array([fp], dtype=np.uint64), np.array([other], dtype=np.uint64)
    assert any(simhash.close_pairs(a, b, s, 3)[0, 0] for s in range(8))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_similar_texts_find_each_other(spark):
    """Copies with a few words changed (0.85 of the five-word shingles and more) join; unrelated texts stay alone."""
    rng = np.random.default_rng(5)
    rows, originals = [], 60
    for i in range(originals):
        words = [f"w{x}" for x in rng.integers(0, 3000, 400)]
        rows.append((i, " ".join(words)))
        for k in (1, 2, 3, 4, 5):
            changed = list(words)
            for at in rng.choice(400, k, replace=False):
                changed[at] = f"x{at}"
            rows.append((1000 * k + i, " ".join(changed)))
    rows += [(9000, None), (9001, ""), (9002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert len(group) == len(rows) and group[9001] == group[9002] == group[9000] == 9000
    assert all(c in (i % 1000, i) for i, c in group.items() if i < 9000)
    assert sum(c == i % 1000 for i, c in group.items() if i < 9000) >= 0.98 * 6 * originals
    assert simhash.similar_components(empty(spark)).count() == 0


def test_similar_groups_are_those_of_exact_jaccard(spark):
    """Similarities around 0.8, long shared passages and chains: groups are those of all pairs compared by their shingles."""
    rng = np.random.default_rng(11)
    passage = [f"p{x}" for x in range(150)]
    texts = {}
    for i in range(80):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)] + passage * (i % 2)
        texts[i] = " ".join(words)
        for k in range(1, 6):
            changed = list(words)
            for at in rng.choice(len(words), 2 * k + int(rng.integers(0, 4)), replace=False):
                changed[at] = f"x{rng.integers(0, 10**6)}"
            texts[1000 * k + i] = " ".join(changed)
    sets = {i: {tuple(p[k : k + 5]) for k in range(len(p) - 4)} for i, p in ((i, t.split()) for i, t in texts.items())}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if j < i and 9 * (n := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) and n:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    assert 80 < len(set(group.values())) < 400
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()} == group


def test_verified_links_of_sets_on_disk(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 1000)
    sets = [np.arange(k, k + 300, dtype="<u8") for k in range(0, 300, 20)] + [np.arange(5000, 5300, dtype="<u8")]
    made = [(7, i, 1, 1, 1, 1, s.tobytes()) for i, s in enumerate(sets)]
    schema = "key long, id long, r0 long, r1 long, r2 long, r3 long, shingles binary"
    got = {r["id"]: r["component"] for r in components(simhash.verified_links(spark.createDataFrame(made, schema))).collect()}
    assert got == {i: 0 for i in range(15)}


def test_bucket_trees_reach_all_that_links_reach():
    rng = np.random.default_rng(9)
    at = np.sort(rng.integers(0, 4000, 700))
    a, b = simhash.bucket_links(at, lambda i, j: abs(at[i][:, None] - at[j][None, :]) <= 5)
    root = np.cumsum(np.r_[True, np.diff(at) > 5])
    named = dict(zip(at.tolist(), root.tolist()))
    assert all(named[x] == named[y] for x, y in zip(a, b)) and len(a) == len(at) - root[-1]
