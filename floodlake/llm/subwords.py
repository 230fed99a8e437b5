"""Token ids of many texts at once, by the public tokenizers.

Tokenizers are slow on running text, but they never join two pieces of text
where ``pieces`` cuts it.  So each distinct piece is given to the library once
in a worker, and texts are put together from the ids of their pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers

from .bytetext import Lookup, Words

#: Pieces that a worker remembers at most; beyond, it begins anew.
REMEMBERED = 1 << 20
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

_WHITE = 0x20
#: Last byte of U+2581, which sentencepiece takes for a space.
_BAR = 0x81
#: Bytes that begin a character which is printed, without those whose characters may be white space.
_PRINTED = np.zeros(256, dtype=bool)
_PRINTED[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xEE), *range(0xEF, 0xF5)]] = True
#: A "<" may begin a special token, which takes the white space before it as the end of a text.
_PRINTED[0x3C] = False
#: One word of Latin letters.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")
#: How a byte-level vocabulary spells each byte: printed Latin-1 as itself, the others in turn by what follows U+00FF.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PRINTED & ~_LETTER & (np.arange(256) < 0x7F)
_MARK[0x7C] = False
_LINE = 0x0A
#: Before a single end of line; a special token may end in ">".
_ENDING = _PRINTED & (np.arange(256) < 0x7F)
_ENDING[0x3E] = False


def pieces(row: int, data: np.ndarray, text: np.ndarray, *, marks: bool = False) -> Words:
    """Cuts texts before each single space that a printed character follows.

    A byte-level tokenizer begins a word there, whatever stands before; a
    sentencepiece vocabulary has no piece with a space inside (checked when it
    is loaded).  ``marks`` cuts between an ASCII letter and an ASCII mark or
    digit and after a single end of line too, where only byte-level tokenizers
    always cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[text] = True
    if n > 1:
        inner = (data[1:] == _WHITE) & (data[:-1] != _WHITE) & (data[:-1] != _BAR)
        inner[:-1] &= _PRINTED[data[2:]]
        inner[-1] = False
        if marks:
            inner |= _LETTER[data[:-1]] & _MARK[data[1:]]
            inner[1:] |= (data[1:-1] == _LINE) & _ENDING[data[:-2]] & _PRINTED[data[2:]]
        cut[1:n] |= inner
    cut[n] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    return Words(row, data, start, end, np.searchsorted(start, text), text)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for size[i] steps, of all i in turn."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(first - (ends - size), size)


class Encoder:
    """Ids of pieces, remembered by their hashes; what was seen lately stands in a small table of its own."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)
        self.keys = [np.zeros(0, dtype=np.uint64)] * 2
        self.tables = [Lookup(k) for k in self.keys]

    def _learn(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        old, new = self.keys[0], np.concatenate([self.keys[1], keys])
        if len(new) > max(20_000, len(old) // 4):
            old, new = np.concatenate([old, new]), new[:0]
            self.tables[0] = Lookup(old)
        self.keys = [old, new]
        self.tables[1] = Lookup(new)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.tables[0].find(hashes)
        left = np.flatnonzero(at < 0)
        if len(left) and len(self.keys[1]):
            found = self.tables[1].find(hashes[left])
            at[left] = np.where(found < 0, -1, found + len(self.keys[0]))
        return at

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        hashes = words.hashes()
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if len(self.start) + len(keys) > REMEMBERED:
                self._forget()
                keys, first = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            self._learn(keys, self._encode([words.word(new[i]) for i in first]))
            at = self._find(hashes)
        size = self.start[at + 1] - self.start[at]
        ids = self.ids[spread(self.start[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[words.first])


@lru_cache(maxsize=2)
def byte_encoder(path: str | None = None, *, plain: bool = False) -> Encoder:
    """The byte-level tokenizer, one for all tasks of a worker; ``plain`` takes the strings of special tokens as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path(BYTE_BPE))
    tokenizer.encode_special_tokens = plain
    model = tokenizer.model

    def encode(found: list[bytes]) -> list[list[int]]:
        """Of one word the library's model is asked, which is quicker; all else goes the whole way."""
        word = [_WORD.fullmatch(x) is not None for x in found]
        rest = iter(tokenizer.encode_batch_fast([x.decode() for x, w in zip(found, word, strict=True) if not w], add_special_tokens=False))
        return [[t.id for t in model.tokenize(x.decode("latin-1").translate(_SPELT))] if w else next(rest).ids for x, w in zip(found, word, strict=True)]

    return Encoder(encode)


@lru_cache(maxsize=1)
def piece_encoder(path: str | None = None) -> Encoder:
    """The sentencepiece tokenizer, one for all tasks of a worker.  Each piece must begin with the space that the tokenizer itself would add."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECE_BPE))
    if any("▁" in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size())):
        raise ValueError("the vocabulary has pieces with a space inside, so texts can't be cut at spaces")

    def encode(found: list[bytes]) -> list[list[int]]:
        return processor.encode([x[1:].decode() for x in found], num_threads=1)

    return Encoder(encode)


def byte_tokens(path: str | None = None) -> list[bytes]:
    """The bytes of each id of the byte-level tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path(BYTE_BPE))
    letters = {c: b for b, c in _SPELT.items()}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    found = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        found[i] = added[i].encode() if i in added else bytes(letters[c] for c in token)
    return found


def piece_tokens(path: str | None = None) -> list[bytes]:
    """The bytes of each id of the sentencepiece tokenizer."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECE_BPE))
    return [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in range(processor.get_piece_size())]
