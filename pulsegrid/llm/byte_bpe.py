"""Byte-level BPE with the tokenizers library over Arrow batches, and its way back.

Text becomes bytes, bytes become the printable characters of the byte table, and each match of the split pattern is
merged on its own by the library's model. Decoding looks every id's characters up and reverses the byte table; bytes
are joined before they are read as UTF-8, so characters that are split over ids come back whole. The byte lengths of
the ids and the first bytes of the characters give the code points that every id covers.

Most words come again, so a worker keeps the ids of words seen (bounded tables). A text is cut at single spaces
followed by a non-space first: the pattern never matches across such a place, because it takes a space only together
with what follows. Texts with runs of white space are cut by the pattern alone. Letters with ASCII marks behind them are
two matches if the pattern cuts the first word with these marks so, and share the entry of the letters.

Letters and numbers are those of the ``regex`` library; in scripts that the newest Unicode versions have added (from
U+10E00 on) libraries class a few characters differently. Defined cases: a null text counts as empty and has no ids; special
tokens' strings in a text are ordinary text, unless a codec is asked to take the file's added tokens as the library does.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import re
import string
import sys
import types
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import with_columns

#: Entries that a worker's tables of words, of matches and of marks hold at most, and the longest word they keep.
KEPT_WORDS, KEPT_MATCHES, KEPT_TAILS = 500_000, 300_000, 10_000
KEPT_LENGTH = 40
#: Marks that may follow a word's letters.
TAIL = string.punctuation


def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


def tokenizer_from_ranks(path: str) -> str:
    """The library's JSON for a file of base64 tokens and ranks: every way to join two tokens into a third is a merge."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = byte_table()
    shown = {k: "".join(table[b] for b in k) for k in ranks}
    merges = [(r, ranks[k[:i]], ranks[k[i:]], shown[k[:i]], shown[k[i:]]) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
    merges.sort()
    t = Tokenizer(models.BPE(vocab={shown[k]: r for k, r in ranks.items()}, merges=[(a, b) for *_, a, b in merges], ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    t.decoder = decoders.ByteLevel()
    return t.to_str()


def tokenizer_json(path: str) -> str:
    """The library's JSON of a vocabulary file: a tokenizer's JSON as it is, or a table of ranks."""
    if path.endswith(".tiktoken"):
        return tokenizer_from_ranks(path)
    with open(path, encoding="utf-8") as f:
        return f.read()


def memo(key: str, make: Callable[[], object]) -> object:
    """A value kept by a Python worker, which serves many tasks, until it needs another one."""
    held = sys.modules.setdefault("_pulsegrid_llm_memo", types.ModuleType("_pulsegrid_llm_memo")).__dict__
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


class Kept(dict):
    """A bounded table of what ``make`` gives for words; words that it doesn't hold are made each time."""

    def __init__(self, make: Callable[[str], object], limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> object:
        found = self.make(word)
        if len(self) < self.limit and len(word) <= KEPT_LENGTH:
            self[word] = found
        return found


class Codec:
    """Encodes and decodes texts by one vocabulary."""

    _double_space = re.compile(r" \s")

    def __init__(self, source: str, pattern: str, added: bool = False, words: int = KEPT_WORDS, matches: int = KEPT_MATCHES) -> None:
        """``added``: the file's added tokens are cut out of a text first, as the library's own ``encode`` does.
        ``words``, ``matches``: entries that the tables hold at most."""
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(source)
        self.model = t.model
        self.split = regex.compile(pattern).findall
        letters = " " + "".join(filter(str.isalpha, map(chr, range(sys.maxunicode + 1))))
        self.by_letters = self.split(letters) == [letters]
        self.tails: dict[str, bool] = {}  # marks behind letters: whether they are a match of their own
        table = byte_table()
        self.shown = "".join(table)
        back = {c: b for b, c in enumerate(table)}
        vocab = t.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ids = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int32)
        self.added = {a.content: np.array([i], dtype=self.ids).tobytes() for i, a in t.get_added_tokens_decoder().items()} if added else {}
        if added and any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in t.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=lambda x: -len(x))) + ")") if self.added else None
        self.code = "H" if self.ids is np.uint16 else "I"
        self.spaced = Kept(self.unit, words)  # a word after a space: its ids
        self.matches = Kept(self._match, matches)  # a match of the pattern: its ids

    def _match(self, match: str) -> bytes:
        mapped = codecs.charmap_decode(match.encode(), "strict", self.shown)[0]
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _part(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.split(text)))

    def unit(self, word: str) -> bytes:
        """Ids of a word after a space; letters alone are one match, marks behind them another one."""
        if self.by_letters and word.isalpha():
            return self._match(" " + word)
        letters = word.rstrip(TAIL)
        tail = word[len(letters) :]
        if self.by_letters and tail and letters.isalpha():
            if self.tails.get(tail):
                return self.spaced[letters] + self.matches[tail]
            if tail not in self.tails and len(self.tails) < KEPT_TAILS and len(tail) <= KEPT_LENGTH:
                self.tails[tail] = self.split(" " + word) == [" " + letters, tail]
                return self.unit(word) if self.tails[tail] else self._part(" " + word)
        return self._part(" " + word)

    def units(self, body: str) -> list[str] | None:
        """``body`` cut at its spaces, or None where white space follows a space."""
        return None if self._double_space.search(body) else body.split(" ")

    def encode(self, text: bytes) -> np.ndarray:
        body = text.decode()
        if self.cut and any(map(body.__contains__, self.added)):
            return np.frombuffer(b"".join([self.added[x] if x in self.added else self._part(x) for x in self.cut.split(body)]), dtype=self.ids)
        units = self.units(body)
        if units is None:
            return np.frombuffer(self._part(body), dtype=self.ids)
        return np.frombuffer(self._part(units[0]) + b"".join(map(self.spaced.__getitem__, units[1:])), dtype=self.ids)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """First code point and the one after the last of every id of ``text``; ids that share a character all cover it."""
        ends = np.cumsum(self.length[ids])
        starts_character = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
        character = np.cumsum(starts_character, dtype=np.int32) - 1  # of each byte
        return np.column_stack([character[ends - self.length[ids]], character[ends - 1] + 1]).astype(np.int32)


def codec(source: str, pattern: str, added: bool = False) -> Codec:
    return memo(f"codec{added}" + hashlib.sha256((source + pattern).encode()).hexdigest(), lambda: Codec(source, pattern, added))


def encode_decode(docs: DataFrame, source: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256`` (of the bytes
    that the ids decode to), ``n_split`` (ids that share a character with the id before) and ``offsets_sha256`` (of all
    starts and ends in code points, little-endian unsigned 32-bit, id by id) behind its columns but the text; with ``ids``
    also ``ids``, ``starts``, ``ends`` (arrays) and ``decoded``."""

    def make() -> Callable[[list[bytes]], list]:
        c = codec(source, pattern)

        def work(texts: list[bytes]) -> list:
            n, id_hashes, text_hashes, split, place_hashes, all_ids, starts, ends, decoded = ([] for _ in range(9))
            for x in texts:
                own = c.encode(x)
                listed = own.tolist()
                body = b"".join(map(c.bytes_of.__getitem__, listed))
                n.append(len(listed))
                id_hashes.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, listed)).encode()).hexdigest())
                text_hashes.append(hashlib.sha256(body).hexdigest())
                places = c.offsets(x, own)
                split.append(int((places[1:, 0] < places[:-1, 1]).sum()))
                place_hashes.append(hashlib.sha256(places.astype("<u4").tobytes()).hexdigest())
                if ids:
                    all_ids.append(listed)
                    starts.append(places[:, 0])
                    ends.append(places[:, 1])
                    decoded.append(body.decode("utf-8", "replace"))
            arrays = [pa.array(a, pa.list_(pa.int32())) for a in (all_ids, starts, ends)]
            return [n, id_hashes, text_hashes, split, place_hashes] + ([*arrays, decoded] if ids else [])

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("n_split", T.LongType()), T.StructField("offsets_sha256", T.StringType())]
    if ids:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")] + [T.StructField("decoded", T.StringType())]
    made = {f.name.lower() for f in fields}
    return with_columns(docs, make, fields, keep=[c for c in docs.columns if c != text and c.lower() not in made], column=text)
