"""Tokenizing by white-space pieces, with memory and a vectorised merge of new words.

The word tokenizer drops white space and never merges over it, so the ids of a text are the ids
of its white-space pieces, one after another. Texts are cut into words as bytes, words are found
by 64-bit hashes in a table of those that the worker has met (a bounded memory), and the ids of
a whole slice are gathered at once. New ASCII words are split into letters, digits and other
signs and merged together by the tokenizer's own merge table without becoming Python strings;
others are split by its own pattern, or go to the tokenizer; so does a whole text with
separators on which the two disagree. Tests hold the result against the tokenizer's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textcore as tc

_ODD = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xe2\x80\x8b", b"\xef\xbb\xbf", b"<|")
#: Composed characters on whose case and class both sides agree.
_PLAIN = re.compile("[\x21-\x7e¡-¬®-įı-ňŊ-ž]*")
#: Words that a worker keeps, if one slice has no more.
_MOST_KEPT = 1 << 20
_NONE = np.iinfo(np.int64).max
_loaded: dict[str, "WordIds"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, more = {}, 256
    for b in range(256):
        signs[b] = chr(b) if b in shown else chr(more)
        more += b not in shown
    return [signs[b] for b in range(256)]


class Merges:
    """Byte-pair merging of many words at once.

    All words lie in one flat array of ids. In each round every word merges the leftmost of its
    pairs of lowest rank, until no word has a pair of the table.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key, first = np.unique(key, return_index=True)
        self.key, self.rank, self.new = key, first.astype(np.int64), new[first]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * -7046029254386353131) >> 42) & 0x3FFFFF

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, as rank << 20 | entry; _NONE if absent."""
        out = np.full(len(pair), _NONE, np.int64)
        maybe = np.flatnonzero(self.seen[self._slot(pair)])
        at = np.minimum(np.searchsorted(self.key, pair[maybe]), len(self.key) - 1)
        hit = self.key[at] == pair[maybe]
        out[maybe[hit]] = self.rank[at[hit]] << 20 | at[hit]
        return out

    def ids(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). raw: bytes of words of these lengths, none empty."""
        n = len(lens)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        tok = self.inner[raw]
        ends = np.cumsum(lens)
        tok[ends - 1] = self.last[raw[ends - 1]]
        own = np.repeat(np.arange(n), lens)
        done_tok, done_own = [], []
        rank = self._pair_ranks(tok, own)
        while len(tok):
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(tok)))
            live = best != _NONE
            if not live.all():
                gone = np.repeat(~live, sizes)
                done_tok.append(tok[gone])
                done_own.append(own[gone])
                tok, own, rank = tok[~gone], own[~gone], rank[~gone]
                best, sizes = best[live], sizes[live]
                if not len(tok):
                    break
                start = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[np.concatenate([[True], own[at][1:] != own[at][:-1]])]  # the leftmost of each word
            tok[at] = self.new[rank[at] & 0xFFFFF]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            touched = np.zeros(len(tok), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            tok, own, rank, touched = tok[keep], own[keep], rank[keep], touched[keep]
            again = np.flatnonzero(touched)
            nxt = np.minimum(again + 1, len(tok) - 1)
            fresh = self._ranks(tok[again] << 20 | tok[nxt])
            fresh[(own[again] != own[nxt]) | (again == nxt)] = _NONE
            rank[again] = fresh
        tok, own = np.concatenate(done_tok), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return tok[order].astype(np.uint32), np.bincount(own, minlength=n)

    def _pair_ranks(self, tok: np.ndarray, own: np.ndarray) -> np.ndarray:
        rank = np.full(len(tok), _NONE, np.int64)
        rank[:-1] = self._ranks(tok[:-1] << 20 | tok[1:])
        rank[:-1][own[:-1] != own[1:]] = _NONE
        return rank


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data, eight bytes at a time; 16 bytes must follow the last."""
    at_once = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo, at, left = np.arange(len(start)), start, size
    while len(todo):
        part = at_once[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        h[todo] = tc.mix(h[todo] ^ part)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + count[i] - 1 of every i, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class WordTable:
    """Ids of the words met, by hash: open addressing in arrays."""

    def __init__(self, room: int):
        self.room, self.bits = room, max(4, (2 * room - 1).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)  # number of the word there and one; 0: free
        self.hash = np.zeros(room, np.uint64)
        self.first, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ids, self.n, self.used = np.zeros(room, np.uint32), 0, 0

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 if it is not there."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), self._place(h)
        while len(todo):
            k = self.slot[at] - 1
            hit = (k >= 0) & (self.hash[k] == h[todo])
            out[todo[hit]] = k[hit]
            more = (k >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & (len(self.slot) - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New, different hashes."""
        new = np.arange(self.n, self.n + len(h))
        self.hash[new], self.count[new], self.first[new] = h, count, self.used + np.cumsum(count) - count
        self.n += len(h)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(ids) + len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = self._place(h)
        while len(new):
            free = np.flatnonzero(self.slot[at] == 0)
            place, k = np.unique(at[free], return_index=True)
            self.slot[place] = new[free[k]] + 1
            left = np.ones(len(new), bool)
            left[free[k]] = False
            new, at = new[left], (at[left] + 1) & (len(self.slot) - 1)


#: 0: letters (with the two bytes of those from À to ÿ), 1: digits, 2: other signs, 3: what the
#: tokenizer's own pattern has to split.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = 0
_KIND[39] = 3


def _letters(data: np.ndarray) -> np.ndarray:
    """First bytes of the letters from À to ÿ."""
    at = np.flatnonzero(data[:-1] == 0xC3)
    second = data[at + 1]
    return at[(second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)]


class WordIds:
    """Token ids of whole texts, as unsigned 32-bit values."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"] + "|\n")
        self.known = WordTable(_MOST_KEPT)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _merged(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the pre-tokens at these places of raw; equal ones are merged once."""
        _, one, which = np.unique(word_hashes(raw, first, first + size), return_index=True, return_inverse=True)
        ids, n = self.merges.ids(raw[spread(first[one], size[one])], size[one])
        return ids[spread((np.cumsum(n) - n)[which], n[which])], n[which]

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words without signs of kind 3."""
        size = end - start
        raw = tc.LOWER[data[spread(start, size)]]
        kind = _KIND[raw]
        at = _letters(raw)
        kind[at] = kind[at + 1] = 0
        raw[at + 1] |= np.where(raw[at + 1] != 0x9F, 0x20, 0).astype(np.uint8)
        begins = np.ones(len(raw), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        begins[np.cumsum(size) - size] = True
        first = np.flatnonzero(begins)
        ids, n = self._merged(np.append(raw, np.zeros(16, np.uint8)), first, np.diff(np.append(first, len(raw))))
        word = np.repeat(np.arange(len(size)), size)[first]
        return ids, np.bincount(word, n, len(size)).astype(np.int64)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of any words."""
        out: list = [None] * len(words)
        full = _PLAIN.fullmatch
        plain = [i for i, x in enumerate(words) if full(x)]
        if plain:
            parts = self.pattern.findall("\n".join(words[i] for i in plain).lower())
            used = list(set(parts) - {"\n"})
            raw = [x.encode() for x in used]
            ids, n = self.merges.ids(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
            known = dict(zip(used, np.split(ids, np.cumsum(n)[:-1]))) if used else {}
            marks = [k for k, x in enumerate(parts) if x == "\n"]
            at = 0
            for i, m in zip(plain, [*marks, len(parts)]):
                out[i] = np.concatenate([known[x] for x in parts[at:m]]) if m > at else np.zeros(0, np.uint32)
                at = m + 1
        for i, x in enumerate(words):
            if out[i] is None:
                out[i] = self._whole(x)
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.fromiter(map(len, out), np.int64, len(out))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        odd, other, at = np.zeros(len(data) + 1, np.int64), _KIND[data] == 3, _letters(data)
        other[at] = other[at + 1] = False
        np.cumsum(other, out=odd[1:])
        odd = odd[end] > odd[start]
        k = np.flatnonzero(~odd)
        if len(k):
            self.known.add(h[k], *self._plain(data, start[k], end[k]))
        k = np.flatnonzero(odd)
        if len(k):
            raw = data.tobytes()
            self.known.add(h[k], *self._others([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[k].tolist(), end[k].tolist())]))

    def slices(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of their texts, where each text's ids begin and the end)."""
        raw, offs = tc.strings(col)
        for a, b in tc.slices(offs):
            own = offs[a : b + 1] - offs[a]
            data = np.append(raw[offs[a] : offs[b]], np.zeros(16, np.uint8))
            space = tc.SPACE[data]
            edge = np.zeros(len(data), bool)
            edge[own] = True
            space[-16:] = True
            start = np.flatnonzero(~space & (edge | np.append(True, space[:-1])))
            end = np.flatnonzero(~space[:-1] & (edge[1:] | space[1:])) + 1
            h = word_hashes(data, start, end)
            number = self.known.find(h)
            if len(new := np.flatnonzero(number < 0)):
                one = new[np.unique(h[new], return_index=True)[1]]
                if self.known.n + len(one) > self.known.room:
                    one, new = np.unique(h, return_index=True)[1], np.arange(len(h))
                    self.known = WordTable(max(_MOST_KEPT, len(one)))
                self._learn(h[one], data, start[one], end[one])
                number[new] = self.known.find(h[new])
            n = self.known.count[number]
            ids = self.known.ids[spread(self.known.first[number], n)]
            at = np.append(0, np.cumsum(n))[np.searchsorted(start, own)]
            text = data[:-16].tobytes()
            if any(x in text for x in _ODD):
                parts = np.split(ids, at[1:-1])
                for d in range(b - a):
                    if any(x in text[own[d] : own[d + 1]] for x in _ODD):
                        parts[d] = self._whole(text[own[d] : own[d + 1]].decode("utf-8", "replace"))
                ids, at = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
            yield a, b, ids, at

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit values."""
        return [ids[at[d] : at[d + 1]].astype("<u4") for a, b, ids, at in self.slices(pa.array(texts, pa.string())) for d in range(b - a)]
