"""Token ids of whole texts by a tokenizers file, with the ids of words remembered.

The vocabulary's pre-tokenizer never lets a token cross white space, and its normalisation works within what white space
separates, so the ids of a text are the ids of its ASCII-space-separated chunks, one after the other. Where a text has only
characters on which the file's normaliser and pre-tokenizer are beyond doubt (ASCII and the letters of Latin-1), its words go
straight to the library's BPE model; all other texts go through the whole tokenizer, chunk by chunk. Either way only what was
not seen lately goes through the library at all."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

_CHUNKS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_PLAIN = re.compile(r"[\x20-\x7e\t\n\r\x0b\x0c\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The pre-tokenizer's pattern, as it reads for lower-cased plain characters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9\xdf-\xf6\xf8-\xff]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class WordTokens:
    """max_memo bounds the number of remembered words. Ids are packed as little-endian unsigned 16-bit (wide: 32-bit)."""

    def __init__(self, path: str, max_memo: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.max_memo = max_memo
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        words = _WORDS.findall(text.lower())
        memo = self.words
        out = list(map(memo.get, words))
        if None in out:
            if len(memo) > self.max_memo:
                memo.clear()
            tokenize, packed, letters = self.model.tokenize, self.packed, self.letters
            for i, ids in enumerate(out):
                if ids is None:
                    word = words[i]
                    ids = memo.get(word)
                    if ids is None:
                        shown = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                        ids = memo[word] = b"".join([packed[t.id] for t in tokenize(shown)])
                    out[i] = ids
        return b"".join(out)

    def _any(self, text: str) -> bytes:
        chunks, memo = _CHUNKS.findall(text), self.chunks
        fresh = list({c for c in chunks if c not in memo})
        if len(memo) + len(fresh) > self.max_memo // 4:
            memo.clear()
            fresh = list(set(chunks))
        found = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        memo.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(fresh, found, strict=True))
        return b"".join(map(memo.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        return self._plain(text) if _PLAIN.fullmatch(text) else self._any(text)

    def encode_ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
