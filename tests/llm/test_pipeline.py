import hashlib
import zlib
from collections import Counter

import corpus_pipeline
from pulsegrid.llm.common import stored
from pulsegrid.llm.line_dedup import digest_rows
from pulsegrid.llm.mixing import mix
from pulsegrid.llm.simhash import fingerprint
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def shingles(text, words=5):
    own = text.lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def smallest_of_groups(texts):
    """Ids that stay if texts link at a Jaccard similarity of 0.8 of their five-word shingles (all pairs that share one are
    compared) and where their fingerprints differ in 3 or fewer bits (all pairs)."""
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    group = list(range(len(ids)))
    holders = {}
    for n, own in enumerate(sets):
        shared = Counter(m for s in own or {()} for m in holders.get(s, []))
        for s in own or {()}:
            holders.setdefault(s, []).append(n)
        for m, both in shared.items():
            if not own or 9 * both >= 4 * (len(own) + len(sets[m])):
                a, b = group[m], group[n]
                group = [min(a, b) if g in (a, b) else g for g in group] if a != b else group
    prints = [fingerprint(texts[i], 3) for i in ids]
    for n, own in enumerate(prints):
        for m in range(n):
            if (own ^ prints[m]).bit_count() <= 3 and group[n] != group[m]:
                a, b = group[m], group[n]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {i for n, i in enumerate(ids) if group[n] == n}


def test_stages_take_effect(spark):
    """Every stage against its operator's brute-force-tested rows, and against what it must keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), "test-pipeline")
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == before.columns
        ids, old = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in before.collect()}
        assert ids <= old
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum(labels.get(i) == 0 for i in old - ids) <= 0.02 * len(old)
        elif name == "line_dedup":
            assert ids == old and {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()} == {r["doc_id"]: r["kept_sha256"] for r in digest_rows(before).collect()}
        elif name == "simhash":
            assert ids == smallest_of_groups({r["doc_id"]: (r["text"] or "").encode() for r in before.collect()})
        elif name == "mixing":
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter({r["doc_id"]: r["copies"] for r in mix(before).collect() if r["copies"]})
        else:
            assert docs.count() == before.count()
    again = corpus_pipeline.run(spark, SF)
    digest = lambda df: sorted(zlib.crc32(repr(tuple(r)).encode()) for r in df.collect())
    assert digest(again) == digest(seen["byte_bpe"])


def test_stages_take_odd_tables(spark):
    for docs in (documents(spark), documents(spark).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test-odd")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_near_copies_link_by_fingerprints(spark):
    """Texts within 3 bits are one group though few of their shingles agree; a group goes over links of both kinds."""
    many = "one two three four five six seven " * 200
    tails = [" ".join(f"{t}{i}" for i in range(20)) for t in "abc"]
    words = [f"word{i}" for i in range(60)]
    texts = {4: many + tails[0], 2: many + tails[1], 7: many + tails[1] + " c0", 8: " ".join(words), 9: " ".join([*words[:-6], *"uvwxyz"]), 5: "alone"}
    prints = {i: fingerprint(t.encode(), 3) for i, t in texts.items()}
    assert (prints[4] ^ prints[2]).bit_count() <= 3 < (prints[8] ^ prints[9]).bit_count()
    a, b = shingles(texts[4].encode()), shingles(texts[2].encode())
    assert len(a & b) < 0.8 * len(a | b)
    rows = [*texts.items(), (None, texts[4]), (3, None), (6, "")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 8, 5, 3, None], key=repr)
