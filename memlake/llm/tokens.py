"""Token ids of whole texts with the ``tokenizers`` library.

A byte-level tokenizer cuts a text into pieces before it merges inside them.  ``_PIECES`` finds stretches whose ends are always such
cuts; each different stretch goes through the library's own model once, and its ids are kept in a bounded cache of two generations,
so that what is used again and again stays.  A text that holds one of the tokenizer's added tokens, and any other kind of
tokenizer, is encoded in one call.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from memlake.llm.worker import kept

CACHE_ENTRIES = 200_000
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # Unicode White_Space, as the tokenizer has it
_MARK = f"(?:[^\\w{_W}]|_)"
#: Letters and digits, marks, white space but its last character; a stretch that starts with an apostrophe runs to the next space.
_PIECES = re.compile(f" ?[^\\W_]+|'[^{_W}]*| ?{_MARK}+|[{_W}]+(?=[{_W}][^{_W}])|[{_W}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        pre = declared.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_piece = bool(plain and not declared.get("normalizer"))
        self.added = [t["content"] for t in declared.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype, self.code = (np.dtype("<u2"), "H") if self.width == 2 else (np.dtype("<u4"), "I")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A byte-level model spells each byte as one printable character: bytes that have a visible Latin-1 character as that
        # one, the others as the characters from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.spelling = [chr(b) if b in seen else chr(next(rest)) for b in range(256)]
        self.space = self.spelling[32]
        probe = " aé中x"
        self.spells = self.by_piece and [(self._spell(probe), (0, len(probe)))] == self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)

    def _spell(self, text: str) -> str:
        if text.isascii() and text[:1] == " ":
            return self.space + text[1:]
        return "".join(map(self.spelling.__getitem__, text.encode()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, text: str) -> bytes:
        model = self.tokenizer.model
        if self.spells and (text[1:] if text[0] == " " else text).isalpha():  # letters are one piece; spelling them here saves most of the time
            cuts = [self._spell(text)]
        else:
            cuts = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return array(self.code, [t.id for piece in cuts for t in model.tokenize(piece)]).tobytes()

    def _missing(self, piece: str) -> bytes:
        """Ids of a piece that the younger generation of the cache doesn't hold."""
        found = self.older.get(piece)
        if found is None:
            found = self._piece(piece)
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        self.cache[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(t in text for t in self.added):
            return self._whole(text)
        pieces = _PIECES.findall(text)
        ids = list(map(self.cache.get, pieces))
        if None in ids:
            ids = [self.cache.get(p) or self._missing(p) if i is None else i for i, p in zip(ids, pieces)]
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker and vocabulary."""
    return kept(f"encoder {path}", lambda: Encoder(path), large=True)
