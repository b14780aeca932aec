"""Exact and fast use of the word BPE tokenizer.

The vocabulary's pre-tokenizer never joins characters across white space, and always parts a letter from a following
run of punctuation, so a text's ids are the ids of its words in order. Words repeat, so each worker keeps a bounded map
from word to ids and sends only new words to the tokenizers library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable

_MAX_WORDS = 800_000
_SPACES = str.maketrans("\t\n\r", "   ")
#: Characters at which str.split() parts words, though the pre-tokenizer may keep them.
_UNSURE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85"
_CLOSERS = ".,!?;:%&*#$@+=~^/-_)]}"
#: Letters whose lower case and byte form are one step from the model's alphabet: ASCII and Latin-1.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Texts that show whether a vocabulary parts words as this module takes for granted.
_PROBES = ("Hello, world! It's 2024.", " two  spaces\tand\na line ", "naïve Été—über (x_y) #tag a1b2 don't", "word. (word) [word]; x=1,234.5%", "日本語 текст 𝒳 e\u0301 \u00a0 ß", "ALLCAPS camelCase under_score 'quoted' \"double\"")
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]
_encoders: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; as a map, ids of the words seen so far.

    A vocabulary whose ids of the probe texts differ by words and by whole texts is never taken word by word.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.by_word = True
        # A vocabulary that joins words otherwise is encoded text by text.
        self.by_word = self.encode(_PROBES, 0) == [self._whole(t, 0) for t in _PROBES]
        self.clear()

    def _whole(self, text: str, end_id: int) -> bytes:
        ids = [*self.tokenizer.encode(text, add_special_tokens=False).ids, end_id]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self._look_up(word)
        return found

    def _look_up(self, word: str) -> bytes:
        """Plain words go straight to the BPE model, digits and closing punctuation apart, the others to the tokenizer."""
        plain = word.isascii()
        if word.isalpha() and (plain or _PLAIN.fullmatch(word)):
            lower = word.lower()
            if lower != word:
                return self[lower]
            ids = [t.id for t in self.model.tokenize(word if plain else "".join(map(self.letters.__getitem__, word.encode())))]
            return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
        stem = word.rstrip(_CLOSERS)
        if stem and len(stem) < len(word) and stem[-1].isascii() and stem[-1].isalnum():
            return self[stem] + self[word[len(stem) :]]
        if len(word) > 1 and plain and word.isdigit():
            return b"".join(map(self.__getitem__, word))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str], end_id: int) -> list[bytes]:
        """Ids of each text without special tokens, then ``end_id``."""
        if not self.by_word:
            return [self._whole(text, end_id) for text in texts]
        end, get, out = int(end_id).to_bytes(4, "little"), self.__getitem__, []
        for text in texts:
            if len(self) > _MAX_WORDS:
                self.clear()
            words = [w for w in text.translate(_SPACES).split(" ") if w] if any(c in text for c in _UNSURE) else text.split()
            out.append(b"".join(map(get, words)) + end)
        return out


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
