import base64
import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import token_files
from pulsegrid.llm.byte_bpe import Codec, encode_decode, tokenizer_json
from pulsegrid.llm.common import tokenizer_file
from tests.llm.helpers import documents, empty, rows


@pytest.fixture(scope="module")
def multi():
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return Codec(tokenizer_json(path), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain():
    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return Codec(tokenizer_json(path), P.PATTERN), t


@pytest.fixture(scope="module")
def as_it_comes():
    path = tokenizer_file("byte_bpe_50k.json")
    return Codec(tokenizer_json(path), P.PATTERN, added=True), Tokenizer.from_file(path)


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \t\n'sretdlvm0123aAbBeéèñ中ß.,!#"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_those_of_the_libraries(multi, plain, text):
    c, e = multi
    ids = c.encode(text.encode())
    assert ids.tolist() == e.encode_ordinary(text) and c.decode(ids) == text.encode()
    c, t = plain
    assert c.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_offsets_cover_the_characters_of_each_id(multi, plain, text):
    owner = [i for i, ch in enumerate(text) for _ in ch.encode()]  # character of each byte
    for c in (multi[0], plain[0]):
        ids, want, at = c.encode(text.encode()), [], 0
        for i in ids.tolist():
            own = owner[at : at + len(c.bytes_of[i])]
            want.append([own[0], own[-1] + 1])
            at += len(own)
        assert c.offsets(text.encode(), ids).tolist() == want and at == len(owner)
    c, t = plain
    library = t.encode(text, add_special_tokens=False)
    # the library's post-processor leaves the space in front of a word out of its offsets
    got = c.offsets(text.encode(), np.array(library.ids, dtype=c.ids)).tolist()
    assert [text[a:b].strip() for a, b in got] == [text[a:b].strip() for a, b in library.offsets]


def test_every_character_falls_into_the_same_class(multi, plain):
    (c, e), (d, t) = multi, plain
    differ = []
    for at in range(0, sys.maxunicode, 64):
        own = [chr(i) for i in range(at, at + 64) if not 0xD800 <= i < 0xE000]
        text = "".join(f"a{x}b {x}1{x}" for x in own)
        if c.encode(text.encode()).tolist() != e.encode_ordinary(text) or (at < 0x3000 and d.encode(text.encode()).tolist() != t.encode(text, add_special_tokens=False).ids):
            differ.append(at)
    # only scripts that the newest Unicode versions have added, which the libraries themselves class differently
    assert all(at >= 0x10E00 for at in differ)


def test_rows_against_the_library(spark, multi):
    docs = documents(spark)
    want = []
    for r in docs.collect():
        ids = multi[1].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    source = tokenizer_json(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    out = encode_decode(docs, source, P.PATTERN, ids=True)
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert {r["decoded"] for r in out.where("doc_id = 15").collect()} == {"\U0001f600 emoji 中文"}
    for r, text in zip(out.orderBy("doc_id").collect(), [r["text"] or "" for r in docs.orderBy("doc_id").collect()]):
        places = list(zip(r["starts"], r["ends"]))
        assert r["offsets_sha256"] == hashlib.sha256(np.array(places, dtype="<u4").tobytes()).hexdigest() and len(places) == len(r["ids"])
        assert r["n_split"] == sum(b < a for (_, a), (b, _) in zip(places, places[1:]))
        assert not text or (places[0][0], places[-1][1]) == (0, len(text))
    assert encode_decode(empty(spark), source, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_packing_round_trip(bits, values, data):
    ids = np.array([v & ((1 << bits) - 1) for v in values], dtype=np.uint64)
    packed = token_files.pack(ids, bits)
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert token_files.unpack(packed, bits, start, stop).tolist() == ids[start:stop].tolist()
    assert len(packed) == -(-len(ids) // 8) * bits


SPECIAL = "<|endoftext|>"


def test_token_files_against_the_library(spark):
    """The library's tokenizer as it comes: its special token's string in a text is that token."""
    more = [f"a {SPECIAL} b", SPECIAL, f"{SPECIAL}{SPECIAL}x", f"x{SPECIAL}", f" {SPECIAL}  two\n{SPECIAL}\n", "<|endoftext|", f"<|{SPECIAL}|>", f"{SPECIAL} 's {SPECIAL[:-1]}"]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, x) for i, x in enumerate(more)], "doc_id long, text string")).repartition(5)
    source, library = tokenizer_json(tokenizer_file("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(rows(token_files.token_file_rows(docs, source, P.PATTERN, 50_257), "doc_id", "start", "n_tokens", "ids_crc32")) == want
    assert token_files.token_file_rows(empty(spark), source, P.PATTERN, 50_257).count() == 0


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.one_of(st.just(SPECIAL), st.sampled_from(["<|", "|>", " ", "  ", "\n", "endoftext"]), TEXT), max_size=6).map("".join))
def test_added_tokens_are_cut_as_in_the_library(as_it_comes, text):
    c, t = as_it_comes
    assert c.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_letters_are_one_match_without_the_pattern():
    """A word of letters is tokenized as it stands, with the library's ids; other words still go through the pattern."""
    source = tokenizer_json(P.path("byte_bpe_50k.json"))
    c, library, seen = Codec(source, P.PATTERN), Tokenizer.from_str(source), []
    split = c.split
    c.split = lambda text: (seen.append(text), split(text))[1]
    text = "one Straße 中文 ªº it's 12 word. x́y ½ two\nthree one"
    assert c.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert seen == ["one", " it's", " 12", " word.", " x́y", " ½", " two\nthree"]


def test_marks_behind_letters_share_the_letters_entry(plain):
    """Only the first word with some marks goes through the pattern; letters are kept once for all marks behind them."""
    source = tokenizer_json(P.path("byte_bpe_50k.json"))
    c, library, seen = Codec(source, P.PATTERN), plain[1], []
    split = c.split
    c.split = lambda text: (seen.append(text), split(text))[1]
    text = "a word. other. word.\" others.\" it's word's word, 'word' w'd x.y. third. third.\""
    assert c.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert " word." in seen and not {" other.", " others.\"", " third.", " third.\""} & set(seen)
    assert {"word", "other", "third"} <= c.spaced.keys()
    apart = Codec(source, r" ?\p{L}+[.]?|[^\p{L}]")  # a pattern that takes a mark with the letters
    assert apart.split(" word.") == [" word."] and apart.encode(b"a word. other.").tolist() == apart.encode(b"a word.").tolist() + np.frombuffer(apart._part(" other."), apart.ids).tolist()


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_plain_widths_are_packed_as_bit_by_bit(bits, monkeypatch):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    quick = token_files.pack(ids, bits)
    assert all((token_files.unpack(quick, bits, a, b) == ids[a:b]).all() for a, b in ((0, 1003), (5, 9), (8, 16), (1002, 1003), (7, 7)))
    monkeypatch.setattr(token_files, "WORDS", {})
    assert token_files.pack(ids, bits) == quick
