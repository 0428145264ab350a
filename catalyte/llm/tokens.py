"""Token ids of whole texts with the installed ``tokenizers`` library, fast enough for a corpus.

Encoding a text as one string costs the library about a microsecond a byte, mostly for
offsets that nobody reads. Pre-tokenization makes every piece independent of the others,
so here a text is cut at white space, pieces seen before come from a bounded memo, and only
new ones go through the tokenizer's own model. What holds characters for which the cut might
differ from the library's own (combining marks, unusual white space, ...) is encoded whole,
as is every text that holds one of the vocabulary's added tokens, and everything if the
vocabulary's set-up is not exactly one of the two known here.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from ._shared import kept

#: Characters for which white space, case and normal form are the same everywhere.
PLAIN = "\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-‧€"
ODD = re.compile(f"[^{PLAIN}]")
#: Words a Python worker remembers, about 200 bytes each.
MEMO = 900_000
#: Signs that are a piece of their own behind letters.
SIGNS = frozenset(".,;:!?")
#: The set-ups of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_SETUP = {"normalizer": None, "pre_tokenizer": BYTE_LEVEL | {"use_regex": True}}
WORD_SETUP = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, BYTE_LEVEL | {"use_regex": False}],
    },
}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, by the rule of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes. Bounded: what comes first stays, which
    are the frequent words; the many that occur once are made as they come."""

    def __init__(self, tokenize, other, space: str, signs: dict[str, bytes], most: int):
        self.tokenize, self.other, self.space, self.signs, self.most = tokenize, other, space, signs, most

    def __missing__(self, word: str) -> bytes:
        """Letters with at most one sign behind need no pattern."""
        if word.isascii() and word.isalpha():
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(self.space + word)])
        elif word[-1:] in self.signs and word[:-1].isalpha() and word.isascii():
            ids = self[word[:-1]] + self.signs[word[-1]]
        else:
            ids = self.other(word)
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        setup = json.loads(self.tokenizer.to_str())
        known = {k: setup.get(k) for k in ("normalizer", "pre_tokenizer")}
        plain = setup["model"].get("type") == "BPE" and not any(setup.get(k) for k in ("truncation", "padding")) and not setup["model"].get("dropout")
        #: Added tokens are found in the text itself, before it is cut.
        self.added = [t["content"] for t in setup["added_tokens"]]
        plain = plain and not any(t["normalized"] for t in setup["added_tokens"])
        self.kind, self.space, pattern = "whole", "", ""
        if plain and known == BYTE_SETUP:
            self.kind, self.space, pattern = "byte", " ", BYTE_PATTERN
        elif plain and known == WORD_SETUP:
            self.kind, pattern = "word", WORD_PATTERN
        if self.kind != "whole":
            self.pieces = regex.compile(pattern).findall
            self.tokenize = self.tokenizer.model.tokenize
            self.words = _Words(self.tokenize, self._word, self.letters[32] * len(self.space), {c: self._piece(c) for c in SIGNS}, memo)

    def _piece(self, piece: str) -> bytes:
        found = self.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pieces(text)))

    def _word(self, word: str) -> bytes:
        """A word as it stands behind a space, or by itself for vocabularies that drop spaces."""
        if ODD.search(word):
            return self._whole(self.space + word)
        return self._piece(self.space + word) if word.isalpha() else self._cut(self.space + word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text as bytes."""
        if any(t in text for t in self.added):
            return self._whole(text)
        if self.kind == "byte" and "  " not in text:  # a run of spaces is a piece of its own
            first, *rest = text.split(" ")
            return (self._whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))
        if self.kind == "whole" or ODD.search(text):
            return self._whole(text)
        if self.kind == "word":
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return self._cut(text)


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return kept(("encoder", path, memo), lambda: Encoder(path, memo))


def id_lists(chunks: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids as an Arrow list<int32> column."""
    ends = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum([len(c) // 4 for c in chunks], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(chunks))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def pieces_of(batches, limit: int = 4_000_000):
    """Cut Arrow batches so that each holds about ``limit`` bytes: long texts make small batches."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(limit * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
