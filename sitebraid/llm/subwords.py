"""Whole-text encoding with a public tokenizer file, one library call for each *distinct* piece.

A byte-level or word-end BPE file first cuts a text into pieces by a pattern and then merges inside
each piece, so a piece's ids don't depend on its neighbours. Pieces repeat heavily; each worker keeps
bounded table piece -> packed ids and asks the library only for pieces that it doesn't hold. Texts that
hold an added token's string, or files whose pattern isn't one of the two below, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

# The two published pre-split patterns and their character classes up to U+024F.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "

BYTE_NARROW = re.compile(f"{_CONTRACTIONS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WORD_NARROW = re.compile(f"{_CONTRACTIONS}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_WIDE = re.compile("[^\u0000-ɏ]")
#: Pieces in each of a worker's two tables: a full one becomes the older, and what is met again moves on.
TABLE_ENTRIES = 400_000
#: New pieces that go to the library as one text; characters of the longest piece that a table keeps.
JOINED, LONGEST = 256, 128


@lru_cache(maxsize=1)
def _wide_patterns():
    import regex

    white = r"[\t-\r \x85\xa0  -     　]"
    black = white.replace("[", "[^", 1)
    other = white[:-1].replace("[", "[^", 1) + r"\p{L}\p{N}]"
    byte = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?{other}+|{white}+(?!{black})|{white}+")
    word = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|{other}+")
    return byte, word


def byte_pieces(text: str) -> list[str]:
    return (_wide_patterns()[0] if _WIDE.search(text) else BYTE_NARROW).findall(text)


def lowered(text: str) -> str:
    """NFC and a lower-casing that treats each character alone, as the word-end file asks for."""
    if _WIDE.search(text):
        import unicodedata

        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def word_pieces(text: str) -> list[str]:
    text = lowered(text)
    return (_wide_patterns()[1] if _WIDE.search(text) else WORD_NARROW).findall(text)


class PieceEncoder:
    """encode(texts) gives each text's ids as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x.get("type") for x in pre.get("pretokenizers", [pre])]
        plain = not spec.get("post_processor") and not spec["model"].get("dropout")
        if plain and norm is None and steps == ["ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.split = byte_pieces
        elif plain and steps == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.split = word_pieces
        else:
            self.split = None
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.split is word_pieces:  # a piece ends with the one token that carries the suffix
            suffix = spec["model"]["end_of_word_suffix"]
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        elif self.split is byte_pieces:
            self.newline = self.library.encode("\n", add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without white space inside, many as one text; checked by the number of pieces found."""
        word, found = self.split is word_pieces, {}
        parts = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        texts = [" ".join(p) if word else "\n".join(p) + "\n" for p in parts]
        for part, encoded in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(encoded.ids, "<u4")
            if word:  # a piece ends with the one id that carries the suffix
                stop = np.flatnonzero(self.ends[ids]) + 1
                start = stop - np.diff(stop, prepend=0)
            else:
                stop = np.flatnonzero(ids == self.newline[0])
                start = np.concatenate([[0], stop[:-1] + 1])
            if len(stop) != len(part):
                found.update((p, self._whole(p)) for p in part)
                continue
            packed = ids.tobytes()
            found.update((p, packed[4 * a : 4 * b]) for p, a, b in zip(part, start.tolist(), stop.tolist(), strict=True))
        return found

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces; those that aren't long go into the table."""
        older, new, found = self.older, [], {}
        for p in pieces:
            if (ids := older.get(p)) is not None:
                found[p] = ids
            elif p.isspace() or len(p) > LONGEST:
                found[p] = self._whole(p)
            else:
                new.append(p)
        if new:
            found.update(self._joined(new))
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return [self._whole(t) for t in texts]
        if len(self.known) > self.entries:
            self.known, self.older = {}, self.known
        plain = [not any(a in t for a in self.added) for t in texts]
        cut = [self.split(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        flat = list(chain.from_iterable(cut))
        ids = list(map(self.known.get, flat))
        if None in ids:
            holes = [i for i, x in enumerate(ids) if x is None]
            found = self.learn({flat[i] for i in holes})
            for i in holes:
                ids[i] = found[flat[i]]
        out, at = [], 0
        for t, c, ok in zip(texts, cut, plain, strict=True):
            out.append(b"".join(ids[at : at + len(c)]) if ok else self._whole(t))
            at += len(c)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, entries: int = TABLE_ENTRIES) -> PieceEncoder:
    """One encoder a worker process and file."""
    return PieceEncoder(path, entries)
