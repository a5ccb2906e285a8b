"""Byte-pair encoding and decoding by backtracking.

An Aho-Corasick automaton gives the longest token that starts at every symbol of a word. The encoder takes it, keeps it if
the pair with the token before it is one that merging would leave apart, and otherwise tries the token's next shorter
prefix or goes one token back. A position is marked once it has no way on, so each is tried once. The result equals that of
applying merges in order. Decoding looks tokens up in one buffer by a table of offsets.

Texts beyond Latin letters are composed and lower-cased by the tokenizer file's own normaliser, and cut by its pattern as the
library reads it where they hold characters that Python has no class for, as each comes with its own version of Unicode.

Null and empty texts give no tokens; a null id stays one. Repeated rows give repeated results, an empty table an empty one;
only the id and text columns are read, and those to keep. A text or word of any length is one; nothing is cut.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import id_text

#: Words whose tokens a worker remembers; the memory is emptied when full.
REMEMBERED = 1 << 20
#: Added to the last symbol of a word, in place of the end-of-word suffix.
_LAST = 0xE000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it can be shown, else the next of U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file with word ends, lower case and the byte alphabet."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = _byte_symbols()
        self.to_symbol = {b: ord(s) for b, s in enumerate(self.symbols)}
        size = 1 + max(*vocab.values(), *self.special.values())
        seq: list[str] = [""] * size
        for s in self.symbols:
            seq[vocab[s]], seq[vocab[s + suffix]] = s, chr(ord(s) + _LAST)
        self.parts, self.merged, before = {}, {}, -1
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole <= before:
                raise ValueError("token ids must follow the order of merges")
            before = whole
            self.parts[whole], self.merged[a, b] = (a, b), whole
            seq[whole] = seq[a] + seq[b]
        self.length = [len(s) for s in seq]
        self.ids = {s: i for i, s in enumerate(seq) if s}
        reachable = {s: i for s, i in self.ids.items() if i not in self.parts or self._apply_merges(s) == [i]}
        self.longest = ahocorasick.Automaton()
        for s, i in reachable.items():
            self.longest.add_word(s, i)
        self.longest.make_automaton()
        self.shorter = {i: next((reachable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in reachable), -1) for s, i in reachable.items()}
        texts = [b""] * size
        for t, i in itertools.chain(vocab.items(), self.special.items()):
            texts[i] = t.encode()
        self.buffer = b"".join(texts)
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _apply_merges(self, symbols: str) -> list[int]:
        """Plain merging in order of rank, for telling which tokens merging can reach."""
        got = [self.ids[s] for s in symbols]
        while len(got) > 1:
            best = min((self.merged.get(p, 1 << 60) for p in itertools.pairwise(got)))
            if best == 1 << 60:
                break
            out, i, pair = [], 0, self.parts[best]
            while i < len(got):
                if tuple(got[i : i + 2]) == pair:
                    out.append(best)
                    i += 2
                else:
                    out.append(got[i])
                    i += 1
            got = out
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens alone. Undoes the later merge of both sides step by step:
        a merge across the border wins if it ranks before what is undone."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, bound, fits = left, right, 1 << 60, True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                fits = False
                break
            undo_left = a in self.parts and (b not in self.parts or a > b)
            if undo_left:
                bound, a = a, self.parts[a][1]
            elif b in self.parts:
                bound, b = b + 1, self.parts[b][0]
            else:
                break
        if len(self.fits) >= 1 << 20:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    def encode_word(self, word: str) -> tuple[int, ...]:
        symbols = word.encode("utf-8").decode("latin-1").translate(self.to_symbol)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _LAST)
        length, fits, whole = self.length, self.fits, len(symbols)
        first = [0] * whole
        for end, token in self.longest.iter(symbols):
            first[end + 1 - length[token]] = token
        closed, out, at, token, before = set(), [], 0, first[0], -1
        while True:
            while token >= 0:
                if at + length[token] not in closed:
                    if before < 0:
                        break
                    fit = fits.get((before, token))
                    if self.compatible(before, token) if fit is None else fit:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == whole:
                    return tuple(out)
                before, token = token, first[at]
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        pieces = self.split_special.split(text) if self.split_special else [text]
        out: list[int] = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            words = self.words
            for word in self.split(piece):
                got = words.get(word)
                if got is None:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    got = words[word] = self.encode_word(word)
                out.extend(got)
        return out

    @cached_property
    def composed(self) -> tokenizers.normalizers.Normalizer:
        """The file's own normaliser, whose tables of composition and lower case are of other Unicode versions than Python's."""
        return tokenizers.Tokenizer.from_file(self.path).normalizer

    def split(self, text: str) -> list[str]:
        """Composed form, lower case by single characters, then the words."""
        if text.isascii():
            return _NARROW_WORDS.findall(text.lower())
        if not _WIDE.search(text):
            text = text.lower()
            return (_WORDS if _WIDE.search(text) else _NARROW_WORDS).findall(text)
        text = self.composed.normalize_str(text)
        return [w for w, _ in _SPLIT.pre_tokenize_str(text)] if _unassigned().search(text) else _WORDS.findall(text)

    @property
    def tokens(self) -> list[bytes]:
        """Each id's text, cut out of the buffer by the offsets."""
        if not hasattr(self, "_tokens"):
            self._tokens = [self.buffer[a:b] for a, b in itertools.pairwise(self.offsets.tolist())]
        return self._tokens

    def decode(self, ids) -> bytes:
        """The tokens' texts with a space between, as the file has no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids))


#: What the tokenizer file takes as words, after lower case; white space is nowhere in them, so its runs need no replacing.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS, _SPLIT = regex.compile(_PATTERN), tokenizers.pre_tokenizers.Split(tokenizers.Regex(_PATTERN), "removed", invert=True)
#: The same for texts without characters from U+0250 on, where letters, numbers and spaces are these ranges (fixed values).
_LETTERS, _NUMBERS, _SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NARROW_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")
_WIDE = re.compile("[^\x00-\u024f]")


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern[str]:
    """Characters that Python's Unicode version has no class for; a later one, as the library's, may have."""
    free = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for before, c in zip([-2, *free], free) if c != before + 1]
    ends = [c for c, after in zip(free, [*free[1:], -2]) if after != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, input_ids of every whole text, and the columns to keep; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [v.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), *part.columns[2:]], names=["doc_id", "n_tokens", "input_ids", *keep])

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return id_text(docs, id_col, text_col, keep).mapInArrow(run, "doc_id long, n_tokens long, input_ids array<int>" + kept)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of a table of doc_id, input_ids. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([v.decode(x or ()).decode() for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "input_ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and returns counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        digits = [str(i) for i in range(len(v.tokens))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = v.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
