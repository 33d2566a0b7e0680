"""Ids of a lower-casing word-end BPE (a ``tokenizers`` JSON file), word by word.

The file's normaliser turns white space into one space and its pre-tokeniser drops it, so a text's
ids are its words' ids in a row, and a word needs to be encoded once. Words of ASCII and Latin
letters go through the same merges in ``tiktoken``, where a marker byte stands for the word end;
every other word, and every text in which Python and the file disagree on white space or special
tokens, goes through ``tokenizers`` itself. Texts of Latin-1 are lower-cased first, and full stops
and commas that stand alone become words, so that fewer words need remembering.
"""

from __future__ import annotations

import json
import re
import unicodedata
from struct import pack

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed values of the file format: the word end and the pattern of the pre-tokeniser.
WORD_END = "</w>"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python splits words at these and the file doesn't.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: A full stop or comma beside another mark; such runs are one piece.
RUN = re.compile(r"[.,](?:(?<=[^\w\s][.,])|(?<=_[.,])|(?=[^\w\s]|_))")
#: A byte that no UTF-8 text holds.
MARK = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Remembered(dict):
    """Words' ids; what isn't there comes from ``miss``, which remembers it."""

    def __init__(self, miss):
        self.miss = miss

    def __missing__(self, word: str) -> bytes:
        return self.miss(word)


#: Formats of some ids.
FORMS = [f"<{n}H" for n in range(32)]


def words_of(text: str) -> list[str]:
    """Words whose pieces in a row are those of the text."""
    try:
        text.encode("latin-1")  # beyond it, a word's neighbours matter to its lower case and to its normal form
    except UnicodeEncodeError:
        return text.split()
    low = text.lower()
    return low.split() if RUN.search(low) else low.replace(".", " .").replace(",", " ,").split()


class WordBpe:
    """Encodes texts to little-endian uint16 ids; ``words`` remembered encodings at most, twice."""

    def __init__(self, path: str, words: int = 200_000):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        alphabet = byte_alphabet()
        ranks: dict[bytes, int] = {}
        for token, rank in model["vocab"].items():
            if token not in special:
                end = token.endswith(WORD_END)
                raw = bytes(alphabet[c] for c in (token[: -len(WORD_END)] if end else token))
                ranks[raw + MARK * end] = rank
        if max(model["vocab"].values()) >= 1 << 16:
            raise ValueError("ids need 16 bits at most")
        self.piece = tiktoken.Encoding("word_end", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.limit, self.new, self.old = words, Remembered(self.word), {}

    def plain(self, low: str) -> bytes:
        """Ids of a lower-cased word of ASCII and Latin letters."""
        if low.isalpha():
            ids = self.piece(low.encode() + MARK)
        elif low[:-1].isalpha() and low[-1].isascii():
            # two pieces; the first is known without its end, perhaps
            rest = self.new.get(low[:-1])
            end = self.piece(low[-1].encode() + MARK)
            if rest is not None:
                return rest + pack(f"<{len(end)}H", *end)
            ids = self.piece(low[:-1].encode() + MARK) + end
        else:
            ids = []
            for piece in PIECES.findall(low):
                ids += self.piece(piece.encode() + MARK)
        return pack(FORMS[len(ids)] if len(ids) < len(FORMS) else f"<{len(ids)}H", *ids)

    def word(self, word: str) -> bytes:
        """Ids of one word, remembered: at most ``limit`` recent ones and as many before them."""
        got = self.old.get(word)
        if got is None:
            if word.isascii():
                got = self.plain(word.lower())
            elif max(word) < "ɐ":
                got = self.plain(unicodedata.normalize("NFC", word).lower())
            else:
                ids = self.slow.encode(word, add_special_tokens=False).ids
                got = pack(f"<{len(ids)}H", *ids)
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, Remembered(self.word)
        self.new[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if "<|" in text and self.special.search(text) or ODD_SPACE.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.new.__getitem__, words_of(text)))
