import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import token_alignment
from pulsegrid.llm.byte_bpe import byte_table, tokenizer_json
from pulsegrid.llm.token_alignment import Pieces, alignment_rows, alignments, packed, unpacked
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BACK = {c: b for b, c in enumerate(byte_table())}


@pytest.fixture(scope="module")
def files():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return tokenizer_json(P.path("byte_bpe_50k.json")), P.PATTERN, f.read()


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_tokens(libraries, text):
    """(id, start, end) of both sides as the libraries give them."""
    t, sp = libraries
    if not text:
        return [], []
    a = [(i, bytes(BACK[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    sides = []
    for side in (a, b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return tuple(sides)


def plain_rows(libraries, docs):
    """All pairs of a document's tokens compared, groups cut at common ends."""
    links, rows = {}, []
    sides = [plain_tokens(libraries, text) for _, text in docs]
    for n, (a, b) in enumerate(sides):
        links[n] = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    total = Counter(x for own in links.values() for x in own)
    top = {}
    for (_, j), n in total.items():
        top[j] = max(top.get(j, 0), n)
    for n, ((doc_id, _), (a, b)) in enumerate(zip(docs, sides)):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts))
        own = links[n]
        rows.append((doc_id, len(a), len(b), len(cuts), len(own), sum(total[x] == top[x[1]] for x in own), sum(total[x] for x in own), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return sorted(rows, key=repr)


def own_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_documents_against_all_pairs(spark, files, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    assert own_rows(alignment_rows(docs, *files)) == plain_rows(libraries, [tuple(r) for r in docs.collect()])


def test_many_small_batches_count_alike(spark, files, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = own_rows(alignment_rows(docs, *files))
    monkeypatch.setattr(token_alignment, "BATCH_ENTRIES", 500)
    monkeypatch.setattr(token_alignment, "PIECE", 3000)
    assert own_rows(alignment_rows(docs.repartition(5), *files)) == whole


def test_tables_of_odd_rows(spark, files, libraries):
    more = ["▁ a", " lead", "trail ", "a  b   c", "<s> </s> <unk> <0x41>", "\x00\x01   　", "\U0001f469‍\U0001f52c " * 5, "á̧ ำ", "\n\n\n", " ", "\t"]
    docs = documents(spark).where("doc_id not in (5, 6, 7)").select("doc_id", "text", "key")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "k") for i, t in enumerate(more)], "doc_id long, text string, key string"))
    docs = docs.unionByName(docs.where("doc_id in (2, 3)")).unionByName(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text", "key"))
    assert own_rows(alignment_rows(docs, *files)) == plain_rows(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert alignment_rows(empty(spark), *files).count() == 0
    none = alignment_rows(docs.selectExpr("doc_id", "cast(null as string) text"), *files)
    assert {tuple(r)[1:] for r in none.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_groups_come_when_asked_for(spark, files):
    docs = documents(spark).select("doc_id", "text")
    for r in alignments(docs, *files, keep=True).collect():
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
        assert r["groups"].count(";") + 1 == r["n_groups"] or not r["n_groups"]


@pytest.fixture(scope="module")
def word_pieces(files):
    return Pieces(files[2])


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \t\n\u2581abcdetr'.,0é中"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_are_encoded_like_whole_texts(word_pieces, text):
    assert word_pieces.by_word and word_pieces.encode(text).tolist() == word_pieces.model.encode(text)


def test_packed_links():
    place, times = np.array([0, 7, 900_000, 3, 4, 5, 0]), np.array([1, 2, 70_000, 1, 1, 300, 9])
    assert [x.tolist() for x in unpacked(packed(place, times), 7)] == [place.tolist(), times.tolist()]


@pytest.fixture(scope="module")
def pair(files):
    return token_alignment.Pair(*files)


def test_both_sides_of_a_word_are_kept_together(pair):
    a, b = pair.tokens("the same wörd, the same\nwörd, the end".encode())
    assert set(pair.words) >= {"the", "same", "wörd,", "same\nwörd,", "end"}


@settings(max_examples=500, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \t\n\u2581abcdetr'.,0é中"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_tokens_of_words_are_those_of_whole_texts(pair, text):
    found, body = pair.tokens(text.encode()), b" " + text.encode()
    whole = (pair.a.encode(body).tolist(), pair.b.model.encode(text))
    same = bool(text) and all(b"".join(side.bytes_of[i] for i in ids) == body for side, ids in zip((pair.a, pair.b), whole))
    assert (found is not None) == same and (not same or (found[0].tolist(), found[1].tolist()) == whole)


def test_words_beyond_the_table_are_made_once_a_piece(files, monkeypatch):
    """The table stays within its bound, words beyond it are encoded together, and the ids are the same."""
    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 3)
    small, asked = token_alignment.Pair(*files), []
    made = small._made
    monkeypatch.setattr(small, "_made", lambda words: (asked.append(words), made(words))[1])
    texts = [b"one two three four five", b"five four " + b"x" * 60 + " ﬁve four".encode(), None, "four a▁b".encode(), b"four "]
    found, again = small.tokens_all(texts), small.tokens_all(texts)
    assert len(small.words) == 3 and asked[1] == ["four", "five", "x" * 60, "ﬁve"]
    for text, pair_ids, same in zip(texts, found, again):
        whole = small._whole(text) if text else None
        assert (pair_ids is None) == (same is None) == (whole is None)
        assert whole is None or all((x == y).all() and (x == z).all() and len(x) == len(y) == len(z) for x, y, z in zip(whole, pair_ids, same))


def test_entries_of_a_piece_take_few_bytes(files):
    """What a batch gathers before it closes: eight bytes an entry."""
    *_, place, times = token_alignment.aligned_piece(token_alignment.Pair(*files), [b"some words of a text"] * 50, False)
    assert place.itemsize + times.itemsize == 8 and len(place) == len(times) > 50
