"""Token ids of whole texts by the tokenizers library, with memos for the pieces that recur.

The tokenizer files split a text before every run of spaces and line feeds that follows another character, whatever
stands around it, so a text's ids are the ids of such pieces in turn.  (The lower-case file drops white space, so its
pieces are the words alone.)  A worker process remembers a bounded number of pieces, across tasks; further ones are
encoded each time.  Pieces of ASCII and Latin-1 letters, which need no other rule of the files than those below, go to
the library's BPE model word by word; all others go through the library's whole pipeline.  Texts with other white space
and those that hold one of the file's added tokens (such as its end mark) are encoded whole, as the plain call does.
"""

from __future__ import annotations

import os
import re
import struct

import public_tokenizers

pieces_of = re.compile(r"[ \n]*[^ \n]+").findall
rest_of = re.compile(r"[ \n]+\Z").findall

MOST_PIECES, MOST_WORDS = 1_000_000, 300_000
PIECE_CHARS = 64
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
plain = re.compile(rf"[ \n]?[!-~{LETTERS}]+").fullmatch

# How the two kinds of files split plain pieces into words (contractions, letters, digits, other signs).
BYTE_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s")
LOWER_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


def byte_characters() -> dict[int, str]:
    """The characters that stand for the UTF-8 bytes of a plain character in byte-level vocabularies: printable bytes stand for themselves, the others follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


class Words(dict):
    """word -> packed ids by the library's BPE model, remembered for a bounded number of words."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.signs = model.tokenize, byte_characters()

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize(word.translate(self.signs))]
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MOST_WORDS and len(word) <= PIECE_CHARS:
            self[word] = value
        return value


class Encoder(dict):
    """piece -> packed ids (little-endian unsigned 32-bit numbers), remembered for a bounded number of pieces.

    A piece without white space before it stands for a space and itself, one with a tab for what follows the tab, one
    with a zero character for what follows that, by the whole pipeline.
    """

    def __init__(self, path: str, most: int = MOST_PIECES):
        super().__init__()
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.lower = Words(self.tokenizer.model), self.tokenizer.normalizer is not None
        self.split = (LOWER_WORDS if self.lower else BYTE_WORDS).findall

    def packed(self, texts: list[str]) -> list[bytes]:
        """By the library's whole pipeline."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __missing__(self, piece: str) -> bytes:
        text = piece[1:] if piece[0] in "\t\0" else piece if piece[0] == "\n" or self.lower else " " + piece
        if piece[0] != "\0" and plain(text):
            words = self.words
            value = b"".join([words[w] for w in self.split(text.lower() if self.lower else text)])
        else:
            value = self.packed([text])[0]
        if len(self) < self.most and len(piece) <= PIECE_CHARS:
            self[piece] = value
        return value

    def cut(self, text: str) -> list[str]:
        """The pieces of a text."""
        if not text.replace("\n", "").isprintable() or any(t in text for t in self.added):  # white space other than spaces and line feeds isn't printable
            return ["\0" + text]
        if self.lower:
            return text.split()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return ["\t" + p for p in pieces_of(text) + rest_of(text)]
        first, *lines = text.split("\n")
        out = first.split(" ")
        out[0] = "\t" + out[0]
        for line in lines:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            out += words
        return out

    def encode(self, texts) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.cut(t or ""))) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int = MOST_PIECES) -> Encoder:
    """This process's encoder for a tokenizer file; it remembers no further pieces once there are ``most``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    _encoders[path].most = most
    return _encoders[path]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
