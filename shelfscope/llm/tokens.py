"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

A byte-level or word-end BPE never merges across the border of a run of non-space characters,
so a text's ids are those of its pieces (a run, with the one space before it if any). Each
distinct piece goes through the tokenizers library once while it stays in the cache. The library
cuts a text at its added tokens (such as <|endoftext|>) before all else, and so is done here.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

ID_TYPE = np.dtype("<u4")

# The characters with the White_Space property.
WHITE_ASCII = [9, 10, 11, 12, 13, 32]
WHITE_OTHER = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

WHITE = "".join(map(chr, WHITE_ASCII + WHITE_OTHER))
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
UNSPACED = re.compile(f"[^{WHITE}]+")
# Apart from the blank and the line feed: white space, what str.split() takes for it, and the mark.
RARE_ASCII = [chr(c) for c in (0, 9, 11, 12, 13, *range(0x1C, 0x20))]
RARE = [chr(c) for c in WHITE_OTHER]
TAILS = ".,;:!?"
DOUBLED = ["  ", " \n", "\n ", "\n\n"]
# Letters of Latin-1, whose lower-case forms are single characters, and ASCII marks but the apostrophe, which may
# begin a pre-token of its own with the letters after it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(f"([\0\n]?)([{LETTERS}]+)([{MARKS}]*)")
# Byte-level spelling: the 256th character and on for bytes that have none of their own.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLING = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in SHOWN)}
BLANK = chr(SPELLING[0x20])


class Encoder:
    """Encodes texts; ``limit`` bounds the pieces held.

    With ``added_tokens`` the ids are those of the library as the file sets it up: strings of added
    tokens get their ids. Without, these strings are ordinary text.
    """

    def __init__(self, path: str, limit: int = 800_000, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.limit = limit
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.border = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        # Such tokens are more than their string, and only the library can tell where they are.
        self.whole = any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.ids: dict[str | bytes, bytes] = self._own()
        self.keeps_space = self._ids([" a"]) != self._ids(["a"])
        self.folds = self._ids(["A"]) == self._ids(["a"])
        self.tails = dict(zip(TAILS, self._ids(list(TAILS)), strict=True))
        self.line_feed = self._ids(["\n"])[0]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _own(self) -> dict[str | bytes, bytes]:
        """Added tokens stand among the pieces as their ids."""
        return {ids: ids for ids in self.added.values()}

    def _split(self, text: str) -> list[str | bytes]:
        if not any(a in text for a in self.added):
            return self.pieces(text)
        out: list[str | bytes] = []
        for k, part in enumerate(self.border.split(text)):
            out += [self.added[part]] if k % 2 else self.pieces(part)
        return out

    def pieces(self, text: str) -> list[str]:
        plain = not any(c in text for c in RARE_ASCII)
        plain = plain and (text.isascii() or not any(c in text for c in RARE))
        if not self.keeps_space:
            return text.split() if plain else UNSPACED.findall(text)
        if plain and text and text[-1] not in " \n" and not any(d in text for d in DOUBLED):
            # One blank before every piece but the first of a line, which keeps its line feed.
            first, *rest = text.replace("\n", " \n").split(" ")
            return ["\0" + first, *rest] if first else rest
        return ["\0" + piece for piece in SPACED.findall(text)]

    def _text(self, piece: str) -> str:
        """What a piece stands for: its blank is left out; one that stands for itself is marked."""
        if not self.keeps_space or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def _base(self, piece: str) -> str:
        """The piece without its last mark, if the tokenizer takes that by itself."""
        if piece[-1:] in TAILS and piece[-2:-1].isalpha():
            piece = piece[:-1]
        low = piece.lower() if self.folds and piece.isascii() else piece
        # Lower-casing must not make an added token of what is none.
        return piece if not low.isalpha() and any(a in low for a in self.added) else low

    def _part(self, key: str, pre_token: str) -> bytes:
        """Ids of a pre-token; ``key`` is the piece that is no more than it."""
        ids = self.ids.get(key)
        if ids is None:
            if not pre_token.isascii():
                pre_token = pre_token.encode().decode("latin-1").translate(SPELLING)
            if self.keeps_space and key[0] != "\0":
                pre_token = BLANK + pre_token
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(pre_token)]).tobytes()
            self.ids[key] = ids
        return ids

    def _learn(self, missing: set[str]) -> None:
        rest = []
        for piece in missing:
            # Letters are one pre-token, and so are marks after them: the model can take them at once.
            simple = SIMPLE.fullmatch(piece)
            if not simple or simple[1] and not self.keeps_space:
                rest.append(piece)
                continue
            lead, letters, marks = simple.groups()
            low = letters.lower() if self.folds else letters
            ids = self._part("\0" + low if lead else low, low)
            if lead == "\n":
                ids = self.line_feed + ids
            if marks:
                ids += self._part("\0" + marks if self.keeps_space else marks, marks)
            self.ids[piece] = ids
        bases = {piece: self._base(piece) for piece in rest}
        new = list(set(bases.values()).difference(self.ids))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            self.ids.update(zip(some, self._ids([self._text(p) for p in some]), strict=True))
        for piece, base in bases.items():
            if piece is not base:
                tail = self.tails[piece[-1]] if piece[-1:] in TAILS and len(piece) > len(base) else b""
                self.ids[piece] = self.ids[base] + tail

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.whole:
            return self._ids(texts)
        split = [self._split(t) for t in texts]
        missing = set().union(*split).difference(self.ids)
        if len(self.ids) + len(missing) > self.limit:
            self.ids = self._own()
            missing = set().union(*split).difference(self.ids)
        self._learn(missing)
        get = self.ids.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path, added_tokens=True)
