"""Token ids of whole texts, word by word through the tokenizers library.

The vocabulary in use drops white space and never lets a token cross it, so a text's ids are those of its words in a row.
A word that ends in ASCII punctuation after an ASCII letter is cut there as well (its pattern puts letters and others into
tokens of their own), and words of ASCII letters are looked up in lower case, as the vocabulary's normaliser lowers them.
A worker keeps the ids of the words it has met, as arrays, and asks the library only for new ones.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from redactory.llm._common import _WHITE, U64, lower_ascii, text_buffer, word_hashes

#: A worker forgets its words beyond so many.
CACHED_WORDS = 1_500_000
#: Texts are taken in parts of about so many bytes, which bounds the memory in use; a longer text is a part of its own.
PART_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_OTHER = np.zeros(256, bool)
_OTHER[128:] = True
_OTHER[[ord("<"), ord("|")]] = True

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of words of one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Ask the library; words of ASCII go many at a time, told apart by their offsets."""
        ids: list[list[int]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and "<" not in w]
        rest = [i for i, w in enumerate(words) if not (w.isascii() and "<" not in w)]
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            got = self.library.encode(" ".join([words[i] for i in part]), add_special_tokens=False)
            begin = np.cumsum([0] + [len(words[i]) + 1 for i in part])
            cut = np.searchsorted([x for x, _ in got.offsets], begin).tolist()
            all_ = got.ids
            for k, i in enumerate(part):
                ids[i] = all_[cut[k] : cut[k + 1]]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, got in zip(part, self.library.encode_batch([words[i] for i in part], add_special_tokens=False)):
                ids[i] = got.ids
        lens = np.array([len(x) for x in ids], np.int32)
        starts = np.cumsum(lens, dtype=np.int64) - lens + len(self.ids)
        self.ids = np.concatenate((self.ids, np.fromiter((y for x in ids for y in x), np.uint32, int(lens.sum()))))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.starts, self.lens = (np.insert(old, at, new[order]) for old, new in ((self.keys, keys), (self.starts, starts), (self.lens, lens)))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and each text's offset in them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        word = ~_WHITE[buf]
        begins = word.copy()
        begins[1:] &= ~word[:-1] | (_STOP[buf[1:]] & _LETTER[buf[:-1]])
        begins[offs[:-1][offs[:-1] < len(buf)]] = word[offs[:-1][offs[:-1] < len(buf)]]
        last = word.copy()
        last[:-1] &= ~word[1:] | begins[1:]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
        rows = np.searchsorted(starts, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        low = lower_ascii(buf)
        keys = word_hashes(low, starts, ends)
        other = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_OTHER[buf], out=other[1:])
        odd = np.flatnonzero(other[ends] != other[starts])
        keys[odd] = word_hashes(buf, starts[odd], ends[odd])
        codes, unique = pd.factorize(keys)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != unique)
        else:
            new = np.arange(len(unique))
        if len(new):
            if len(self.keys) + len(new) > CACHED_WORDS and len(self.keys):
                self.forget()
                new = np.arange(len(unique))
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            is_odd = other[ends] != other[starts]
            words = [(buf if is_odd[i] else low)[starts[i] : ends[i]].tobytes().decode() for i in first[new].tolist()]
            self.learn(unique[new], words)
        at = np.searchsorted(self.keys, unique)
        lens = self.lens[at][codes]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        out = self.ids[np.repeat(self.starts[at][codes] - ends[:-1], lens) + np.arange(ends[-1])]
        return out, ends[rows]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(col: pa.Array, path: str, end_id: int):
    """For parts of the column: the rows' range, their ids each with end_id behind, and the offsets of the rows in them."""
    words = encoder(path)
    buf, offs = text_buffer(col)
    row = 0
    while row < len(offs) - 1:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + PART_BYTES, side="right")) - 1)
        ids, at = words.encode(buf[offs[row] : offs[to]], offs[row : to + 1] - offs[row])
        out = np.full(len(ids) + to - row, end_id, np.uint32)
        n = np.diff(at)
        out[np.arange(len(ids)) + np.repeat(np.arange(to - row), n)] = ids
        yield row, to, out, at + np.arange(to - row + 1)
        row = to


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
